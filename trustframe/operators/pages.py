"""Page corpus to element rows, and lookups on them."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import dates
from trustframe.functions.numbers import typed_cell

ELEMENTS = (
    "page string, seq int, tag string, selector string, line int, section string, outer_section string, "
    "section_h3 string, table_no int, row_no int, cell_no int, caption string, summary string, label string, "
    "text string, marked boolean, own_mark string, ignored boolean, hidden boolean, href string"
)
_ARROW = pa.schema([
    (name, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[kind]) for name, kind in (part.split() for part in ELEMENTS.split(", "))
])
FLUSH_ROWS = 20_000
#: Pages that are Python objects at the same time.
PAGES_AT_ONCE = 256
_EMIT = frozenset(P.SEMANTIC_TAGS) | {"td", "th", "dt", "dd", "a", "caption", "title"}
#: Open tags that a start tag ends when their end tag is left out, and the tags that bound the search for them.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "p": ({"p"}, {"div", "section", "article", "li", "td", "th", "dd", "body"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: A text and the plain tag, document type or comment after it: text, slash, name, attributes.
_PLAIN = re.compile(r'([^<]*)<(?:(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*(?:="[^"<>&]*")?)*)|!(?i:doctype) html|!-- [^<>-]*--)>')
_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9-]*)(?:="([^"]*)")?')
#: Elements whose content ends at their end tag alone, and others that parsers of some versions read in another way.
_RAW = frozenset({"script", "style"})
_RAW_TEXT = re.compile(r"(?:[^<]+|<(?!/|!--)|</[a-z][a-z0-9]*>)*+")
_SPECIAL = (frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS) | frozenset(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())) | {"plaintext"}) - _RAW


class _Tree(HTMLParser):
    """The nodes of one page in document order, as parallel lists; a node's text is a span of ``pieces``.

    Building knows nothing of marks, sections or tables: those are derived from the lists afterwards.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.given: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.line: list[int] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.closed: list[int] = []  # number of nodes that had started when this one ended
        self.pieces: list[str] = []
        self.now = -1
        self.unclosed: defaultdict[str, int] = defaultdict(int)

    def handle_starttag(self, tag, attrs):
        self._start(tag, {name: value or "" for name, value in attrs}, self.getpos()[0])

    def _start(self, tag: str, given: dict[str, str], line: int) -> None:
        ended, bounds = _IMPLIED.get(tag, ((), ()))
        if any(self.unclosed[t] for t in ended):
            at = self.now
            while at >= 0 and self.tags[at] not in ended and self.tags[at] not in bounds:
                at = self.parent[at]
            if at >= 0 and self.tags[at] in ended:
                self._close_through(at)
        self.tags.append(tag)
        self.given.append(given)
        self.parent.append(self.now)
        self.line.append(line)
        self.begin.append(len(self.pieces))
        self.end.append(-1)
        self.closed.append(-1)
        self.now = len(self.tags) - 1
        self.unclosed[tag] += 1
        if tag in P.VOID_TAGS:
            self._close_through(self.now)

    def handle_endtag(self, tag):
        if self.unclosed[tag]:
            at = self.now
            while self.tags[at] != tag:
                at = self.parent[at]
            self._close_through(at)

    def handle_data(self, data):
        self.pieces.append(data)

    def read_plain(self, body: str) -> bool:
        """Read a page of plain markup with the parser's result, in a fraction of its time; False, half read, for any other.

        Plain are lower-case tags, attributes in double quotes without references, text, the usual document type, comments without dashes and scripts without comments.
        """
        at, counted, line, lines = 0, 0, 1, "\n" in body
        while token := _PLAIN.match(body, at):
            text, end, tag, attributes = token.groups()
            if text:
                self.pieces.append(unescape(text) if "&" in text else text)
            if tag in _SPECIAL:
                return False
            if end:
                self.handle_endtag(tag)
            elif tag:
                if lines:
                    line += body.count("\n", counted, token.end(1))
                    counted = token.end(1)
                self._start(tag, dict(_ATTRIBUTE.findall(attributes)) if attributes else {}, line)
            at = token.end()
            if not end and tag in _RAW:
                stop = body.find(f"</{tag}", at)
                if not body.startswith(f"</{tag}>", stop) or not _RAW_TEXT.fullmatch(body, at, stop):
                    return False
                if at < stop:
                    self.pieces.append(body[at:stop])
                self.handle_endtag(tag)
                at = stop + len(tag) + 3
        rest = body[at:]
        if "<" in rest:
            return False
        if rest:
            self.pieces.append(unescape(rest))
        return True

    def close(self):
        super().close()
        self._close_through(0)

    def _close_through(self, last: int) -> None:
        while self.now >= max(last, 0):
            at = self.now
            self.end[at], self.closed[at] = len(self.pieces), len(self.tags)
            self.unclosed[self.tags[at]] -= 1
            self.now = self.parent[at]

    def text(self, at: int) -> str:
        return " ".join("".join(self.pieces[self.begin[at]:self.end[at]]).split())


def _parsed(body: str) -> _Tree:
    """The tree of a page: plain markup by one pattern, anything else by the parser."""
    tree = _Tree()
    if not tree.read_plain(body):
        tree = _Tree()
        tree.feed(body)
    tree.close()
    return tree


def _nearest(tree: _Tree, tag: str) -> list[int]:
    """Per node the closest node of that tag on its path, itself included; -1 without one."""
    out: list[int] = []
    for mine, up in zip(tree.tags, tree.parent):
        out.append(len(out) if mine == tag else out[up] if up >= 0 else -1)
    return out


def _is_away(tag: str, given: dict[str, str]) -> bool:
    if tag in P.SUPPRESSED_TAGS:
        return True
    if not given:
        return False
    styles = {"".join(part.split()).lower() for part in given.get("style", "").split(";")}
    return (
        "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
        or given.get("id", "").startswith(P.HIDDEN_ID_PREFIX) or not styles.isdisjoint(P.HIDDEN_STYLES)
    )


def _is_ignored(tag: str, given: dict[str, str], skip_context: re.Pattern) -> bool:
    return tag in P.IGNORED_TAGS or (bool(given) and bool(skip_context.search(f"{given.get('id', '')} {given.get('class', '')}")))


def _element_rows(page: str, tree: _Tree, mark: str, skip_context: re.Pattern, emit: Container[str] = _EMIT) -> Iterator[tuple]:
    """One row per element of interest, from the finished node lists."""
    tags, given, parents, size = tree.tags, tree.given, tree.parent, len(tree.tags)
    # true for nodes that have the property or sit below one that has it (parents come first)
    hidden: list[bool] = []
    marked: list[bool] = []
    ignored: list[bool] = []
    for tag, own, up in zip(tags, given, parents):
        below = up >= 0
        hidden.append((below and hidden[up]) or _is_away(tag, own))
        marked.append((below and marked[up]) or mark in own)
        ignored.append((below and ignored[up]) or _is_ignored(tag, own, skip_context))
    table, details = _nearest(tree, "table"), _nearest(tree, "details")
    order: dict[tuple[int, str], int] = {}  # position among the siblings of one tag
    nth, place = [1] * size, [(None, None, None)] * size
    table_no: dict[int, int] = {}
    row_no: Counter[int] = Counter()
    cell_no: dict[int, int] = {}
    caption: dict[int, str] = {}
    summary: dict[int, str] = {}
    for at, tag in enumerate(tags):
        up = parents[at]
        if up >= 0:
            nth[at] = order[up, tag] = order.get((up, tag), 0) + 1
        inside = table[at]
        if tag == "table":
            table_no[at] = len(table_no) + 1
        elif tag == "summary" and not hidden[at] and details[at] >= 0:
            summary[details[at]] = tree.text(at)
        elif inside >= 0 and tag in ("tr", "td", "th", "caption"):
            cell = None
            if tag == "tr":
                row_no[inside] += 1
                cell_no[inside] = 0
            elif tag == "caption":
                caption[inside] = tree.text(at)
            else:
                cell = cell_no[inside] = cell_no.get(inside, 0) + 1
            place[at] = (table_no[inside], row_no[inside], cell)

    paths: dict[int, str] = {-1: ""}  # selectors of the nodes that have children in the result, each with its final ">"

    def step_of(at: int) -> tuple[str, bool]:
        """A node's own step, and whether a path starts with it."""
        ident = given[at].get("id", "") if given[at] else ""
        if not ident:
            return f"{tags[at]}:nth-of-type({nth[at]})", False
        if re.fullmatch(P.SIMPLE_ID, ident):
            return f"#{ident}", True
        return f"""[id="{re.sub(P.QUOTED_IN_SELECTOR, lambda m: chr(92) + m.group(), ident)}"]""", True

    def selector(at: int) -> str:
        own, whole = step_of(at)
        if whole:
            return f"{page}::{own}"
        up = above = parents[at]
        if up not in paths:
            steps = []
            while above not in paths:
                step, whole = step_of(above)
                steps.append(step)
                above = -1 if whole else parents[above]
            paths[up] = paths[above] + ">".join(reversed(steps)) + ">"
        return f"{page}::{paths[up]}{own}"

    def summary_of(at: int) -> str:
        at = details[at]
        while at >= 0 and at not in summary:
            at = details[parents[at]] if parents[at] >= 0 else -1
        return summary.get(at, "")

    # headings and terms take effect for what starts after their end
    ends = sorted(
        (at for at in range(size) if not hidden[at] and (tags[at] in P.HEADING_TAGS or tags[at] == "dt")),
        key=lambda at: (tree.closed[at], -at),
    )
    done, path, h3, term = 0, [], "", ""
    for at, tag in enumerate(tags):
        while done < len(ends) and tree.closed[ends[done]] <= at:
            body, kind = tree.text(ends[done]), tags[ends[done]]
            done += 1
            if kind == "dt":
                term = body
                continue
            path = [h for h in path if h[0] < kind] + [(kind, body)]
            h3 = body if kind == "h3" else h3
        if tag not in emit and mark not in given[at]:
            continue
        yield (
            page, at, tag, selector(at), tree.line[at], path[-1][1] if path else "", path[-2][1] if len(path) > 1 else "",
            h3, *place[at], caption.get(table[at], "") if place[at][0] else "", summary_of(at) if summary else "",
            term if tag == "dd" else "", tree.text(at), marked[at], given[at].get(mark), ignored[at], hidden[at],
            given[at].get("href"),
        )


def page_elements(pages: DataFrame, page: str, html: str, mark: str = "data-claim-id", tags: Iterable[str] = _EMIT) -> DataFrame:
    """Element rows of every page, with inherited marks and hidden or ignored ancestry: elements of ``tags`` and marked ones.

    The one Python stage of the library: Arrow batches through the standard HTML parser, reading only
    the page key and its text, a few pages at a time.
    """
    skip, emit = re.compile(P.IGNORED_CONTEXT), frozenset(tags)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(start, PAGES_AT_ONCE)
                for key, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if body is None:
                        continue
                    for row in _element_rows(key, _parsed(body), mark, skip, emit):
                        rows.append(row)
                        if len(rows) >= FLUSH_ROWS:
                            yield _as_batch(rows)
                            rows = []
                if rows:
                    yield _as_batch(rows)
                    rows = []

    narrow = pages.select(F.col(page).cast("string").alias("page"), F.col(html).alias("html"))
    return narrow.mapInArrow(parse, ELEMENTS)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def page_markers(pages: DataFrame, page: str, html: str, mark: str = "data-claim-id") -> DataFrame:
    """Distinct marker values per page: (page, marker). Pages without the word are not parsed."""
    some = pages.filter(F.contains(F.lower(F.col(html)), F.lit(mark)))
    found = page_elements(some, page, html, mark, tags=()).filter(F.col("own_mark").isNotNull())
    key = F.col("page").cast(pages.schema[page].dataType).alias(page)
    return found.select(key, F.col("own_mark").alias("marker")).distinct()


def page_links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Anchors per page in document order: (page, seq, href, name)."""
    links = page_elements(pages, page, html, tags=("a",)).filter((F.col("tag") == "a") & (F.col("href") != ""))
    key = F.col("page").cast(pages.schema[page].dataType).alias(page)
    return links.select(key, "seq", "href", F.col("text").alias("name"))


def table_rows(elements: DataFrame) -> DataFrame:
    """Visible table rows as cell arrays: (page, table_no, row_no, section, summary, caption, cells)."""
    cells = elements.filter(F.col("tag").isin("td", "th") & ~F.col("hidden"))
    return cells.groupBy("page", "table_no", "row_no").agg(
        F.max("section").alias("section"), F.max("summary").alias("summary"), F.max("caption").alias("caption"),
        F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]).alias("cells"),
    )


def header_matches(rows: DataFrame, headers: Sequence[str]) -> DataFrame:
    """Per table: how often the exact header row occurs and where."""
    is_header = F.col("cells") == F.array(*map(F.lit, headers))
    return rows.groupBy("page", "table_no").agg(
        F.count_if(is_header).alias("header_rows"), F.min(F.when(is_header, F.col("row_no"))).alias("header_at"),
        F.max("section").alias("section"), F.max("summary").alias("summary"), F.max("caption").alias("caption"),
    )


def typed_table(rows: DataFrame, headers: Sequence[str], types: Sequence[str], unit_label: str | None = None,
                null_token: str = "") -> tuple[DataFrame, DataFrame]:
    """Data rows under the one exact header row as typed numbers, and what is wrong with the rest.

    Returns (values: page, table_no, row_no, values), (problems: page, table_no, row_no, code).
    """
    if unit_label is not None:
        rows = rows.filter(~((F.size("cells") == 2) & (F.col("cells")[0] == unit_label)))
    heads = header_matches(rows, headers)
    bad_head = heads.filter("header_rows <> 1").select(
        "page", "table_no", F.lit(None).cast("int").alias("row_no"), F.lit("HEADER_COUNT").alias("code")
    )
    body = rows.join(heads.filter("header_rows = 1").select("page", "table_no", "header_at"), ["page", "table_no"])
    body = body.filter(F.col("row_no") > F.col("header_at"))
    full = F.size("cells") == len(headers)
    values = F.array(*[typed_cell(F.try_element_at("cells", F.lit(i + 1)), t, null_token) for i, t in enumerate(types)])
    malformed = F.lit(False)
    for i, t in enumerate(types):
        cell = F.try_element_at("cells", F.lit(i + 1))
        miss = typed_cell(cell, t, null_token).isNull()
        if t == "nullable-number":
            miss = miss & (F.trim(cell) != null_token)
        malformed = malformed | miss
    staged = body.select("page", "table_no", "row_no", full.alias("full"), malformed.alias("bad"), values.alias("values"))
    problems = staged.filter("not full or bad").select(
        "page", "table_no", "row_no", F.when(~F.col("full"), F.lit("PARTIAL_ROW")).otherwise(F.lit("BAD_CELL")).alias("code")
    )
    good = staged.filter("full and not bad").select("page", "table_no", "row_no", "values")
    return good, problems.unionByName(bad_head)


def exact_lookup(elements: DataFrame, keys: Sequence[str], where: Column, value: Column) -> DataFrame:
    """Value of the one element that matches, per key; NULL value with the count when not exactly one."""
    hits = elements.filter(where & ~F.col("hidden")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.min(value).alias("__v")
    )
    return hits.select(*keys, "matches", F.when(F.col("matches") == 1, F.col("__v")).alias("value"))


def definition_value(elements: DataFrame, section: str, label: str) -> DataFrame:
    where = (F.col("tag") == "dd") & (F.col("section") == section) & (F.col("label") == label)
    return exact_lookup(elements, ["page"], where, F.col("text"))


def labelled_value(elements: DataFrame, outer: str, label: str) -> DataFrame:
    where = F.col("tag").isin("p", "li") & (F.col("outer_section") == outer) & (F.col("section") == label)
    return exact_lookup(elements, ["page"], where, F.col("text"))


def section_text(elements: DataFrame, heading: str, anchor: str) -> DataFrame:
    where = F.col("tag").isin("p", "li") & (F.col("section_h3") == heading) & (F.col("text") == anchor)
    return exact_lookup(elements, ["page"], where, F.col("text"))


def table_record(rows: DataFrame, section: str, headers: Sequence[str], row_label: str, value_header: str,
                 summary: str | None = None) -> DataFrame:
    """Cell of one labelled row in the one table with this section and header row, per page.

    ``newer_cohort`` is true when a table with the same headers carries a later dated section (or
    summary): the chosen cohort is then out of date and the value is NULL.
    """
    heads = header_matches(rows, headers).filter("header_rows = 1")
    dated = F.col("section") if summary is None else F.col("summary")
    chosen_date = dates.cohort_date(F.lit(section if summary is None else summary))
    later = heads if summary is None else heads.filter(F.col("section") == section)
    newest = later.groupBy("page").agg(F.max(dates.cohort_date(dated)).alias("newest"))
    match = F.col("section") == section
    if summary is not None:
        match = match & (F.col("summary") == summary)
    tables = heads.filter(match).select("page", "table_no", "header_at")
    body = rows.join(tables, ["page", "table_no"]).filter(
        (F.col("row_no") > F.col("header_at")) & (F.size("cells") == len(headers)) & (F.col("cells")[0] == row_label)
    )
    value = F.col("cells")[list(headers).index(value_header)]
    per_page = body.groupBy("page").agg(F.count(F.lit(1)).alias("matches"), F.min(value).alias("__v"))
    table_counts = tables.groupBy("page").agg(F.count(F.lit(1)).alias("tables"))
    out = table_counts.join(per_page, "page", "left").join(newest, "page", "left")
    newer = F.coalesce(F.col("newest") > chosen_date, F.lit(False))
    ok = (F.col("tables") == 1) & (F.col("matches") == 1) & ~newer
    return out.select(
        "page", "tables", F.coalesce("matches", F.lit(0)).alias("matches"), newer.alias("newer_cohort"),
        F.when(ok, F.col("__v")).alias("value"),
    )


def extraction_status(extracted: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """match / changed per key from (value_type, unit, value_text) on both sides (NULL-safe)."""
    cols = ["value_type", "unit", "value_text"]
    e = expected.select(*keys, F.struct(*cols).alias("__e"))
    joined = e.join(extracted.select(*keys, F.struct(*cols).alias("__x")), list(keys), "left")
    return joined.select(
        *keys, F.when(F.col("__x").eqNullSafe(F.col("__e")), F.lit("match")).otherwise(F.lit("changed")).alias("status")
    )
