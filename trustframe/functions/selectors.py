"""Selector paths ``root.b[0].c[key=value]`` over VARIANT documents, resolved inside the row that holds the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.variants import children, json_type, scalar_text

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
_STEP = rf"\.{_NAME}|\[\s*[0-9]+\s*\]|\[\s*{_NAME}\s*=\s*[^\]\s][^\]]*\]"
#: Shares that the selectors of one document are dealt to, so that a document in demand is spread over tasks.
SHARES = 32


def selector_steps(path: Column) -> Column:
    """Steps (name, place, key, wanted) of a path, the root's name first; NULL for a malformed path."""
    clean = F.trim(path)

    def step(text: Column) -> Column:
        inside = F.trim(F.regexp_extract(text, r"(?s)\A\[(.*)\]\z", 1))
        raw = F.trim(F.regexp_extract(inside, r"(?s)\A[^=]*=(.*)\z", 1))
        quoted = F.regexp_extract(raw, r"""(?s)\A(['"])(.*)\1\z""", 1) != ""
        plain = F.regexp_replace(F.substr(raw, F.lit(2), F.greatest(F.char_length(raw) - 2, F.lit(0))), r"\\(.)", "$1")
        select = F.contains(inside, F.lit("="))
        bracket = F.startswith(text, F.lit("["))
        return F.struct(
            F.when(~bracket, F.regexp_replace(text, r"\A\.", "")).alias("name"),
            F.when(bracket & ~select, inside.try_cast("int")).alias("place"),
            F.when(bracket & select, F.trim(F.substring_index(inside, "=", 1))).alias("key"),
            F.when(bracket & select, F.when(quoted, plain).otherwise(raw)).alias("wanted"),
        )

    whole = rf"\A{_NAME}(?:{_STEP})*\z"
    head = F.regexp_extract(clean, rf"\A({_NAME})", 1)
    tail = F.regexp_extract_all(F.substr(clean, F.char_length(head) + 1), F.lit(f"({_STEP})"), F.lit(1))
    return F.when(clean.rlike(whole), F.transform(F.concat(F.array(head), tail), step))


def select_value(document: Column, path: Column) -> Column:
    """(value, problem, hits): what the path selects in a VARIANT document.

    Problems: malformed-path, no-property, no-index, not-array, and no-match or several-matches for a ``[key=value]`` step
    that does not hit exactly one object of an array (``hits`` counts them). The first one ends the walk.
    """
    steps = selector_steps(path)
    none = F.lit(None).cast("variant")
    null = F.parse_json(F.lit("null"))

    def state(value: Column, problem: Column, hits: Column) -> Column:
        return F.struct(value.alias("value"), problem.alias("problem"), hits.alias("hits"))

    def walk(now: Column, step: Column) -> Column:
        members, items = children(now["value"])
        name, place, key = step["name"], step["place"], step["key"]

        def hit(item: Column) -> Column:
            own = children(item)[0]
            return F.coalesce(F.map_contains_key(own, key) & (F.coalesce(scalar_text(F.try_element_at(own, key)), F.lit("null")) == step["wanted"]), F.lit(False))

        by_name = state(
            F.coalesce(F.try_element_at(members, name), null), F.when(~F.coalesce(F.map_contains_key(members, name), F.lit(False)), F.lit("no-property")), F.lit(None).cast("int"))
        by_place = state(
            F.coalesce(F.get(items, place), null), F.when(~F.coalesce(place < F.size(items), F.lit(False)), F.lit("no-index")), F.lit(None).cast("int"))
        found = F.filter(items, hit)
        n = F.size(found)
        by_key = state(
            F.get(found, F.lit(0)),
            F.when(items.isNull(), F.lit("not-array")).when(n == 0, F.lit("no-match")).when(n > 1, F.lit("several-matches")),
            F.when(items.isNotNull(), n))
        return F.when(now["problem"].isNotNull(), now).when(name.isNotNull(), by_name).when(key.isNotNull(), by_key).otherwise(by_place)

    begin = state(document, F.when(steps.isNull(), F.lit("malformed-path")).cast("string"), F.lit(None).cast("int"))
    end = F.aggregate(F.coalesce(steps, F.array().cast(_STEPS)), begin, walk)
    return state(F.when(end["problem"].isNull(), end["value"]).otherwise(none), end["problem"], end["hits"])


_STEPS = "array<struct<name:string,place:int,key:string,wanted:string>>"


def selector_values(selectors: DataFrame, documents: DataFrame, key: str, path: str, document: str) -> DataFrame:
    """Distinct (``key``, ``path``) + (value VARIANT, value_type, value_text, problem, hits).

    ``documents`` has one VARIANT ``document`` per ``key``. Selectors are gathered per document first, in ``SHARES``
    shares, so a document is not copied for each of them. A selector without a document has the problem ``no-document``.
    """
    distinct = selectors.select(key, path).distinct()
    shares = distinct.groupBy(key, F.pmod(F.xxhash64(path), F.lit(SHARES)).alias("__share")).agg(F.collect_list(path).alias("__paths"))
    joined = shares.join(documents.select(key, F.col(document).alias("__doc"), F.lit(True).alias("__known")), key, "left")
    found = joined.select(key, "__known", F.explode(F.transform("__paths", lambda p: F.struct(p.alias("p"), select_value(F.col("__doc"), p).alias("r")))).alias("__x"))
    value = F.col("__x.r.value")
    return found.select(
        key, F.col("__x.p").alias(path), F.when(F.col("__known"), value).alias("value"), F.when(F.col("__known"), json_type(value)).alias("value_type"),
        F.when(F.col("__known"), scalar_text(value)).alias("value_text"),
        F.when(F.col("__known"), F.col("__x.r.problem")).otherwise(F.lit("no-document")).alias("problem"), F.col("__x.r.hits").alias("hits"),
    )
