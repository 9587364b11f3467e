"""Benchmark decontamination through typed templates.

Texts become tokens; numbers, units behind a number and names (capitalised words) become placeholders. Windows of
``WINDOW`` template tokens are hashed. Windows of documents that pass a bit table of fixed size are joined by hash
with the windows of the benchmark; matches on one diagonal (same shift between document and item) are put together,
and the values in their slots are compared: an item's value must stand for one value of the document and the other
way round. An exact copy maps each value to itself, a re-parameterised question maps values consistently, and a
chance match of a template does not.

Sentence-initial capitals are ambiguous, so every text is read twice: as plain words and as names. A third reading
has the exact tokens: windows of an item with too few literal tokens for a template are matched by it, so that they
find verbatim copies. On a diagonal where a template of the item matches, they are compared as templates too.


Defined cases: NULL and empty texts or items match nothing; an item shorter than a window is one window of its own
length; repeated rows give the same answer once per (doc_id, text); an empty benchmark flags nothing. Case and signs
that are no token (such as + and *) are not compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import fresh, releasing
from trustframe.session import cut_lineage, load_table

WINDOW = 6
#: Literal tokens that a template needs to match by itself, so that placeholders alone match nothing.
LEAST_LITERAL = 3
#: Share of an item's windows, or else number of them, that make a leak.
LEAST_SHARE = 0.5
LEAST_WINDOWS = 20
#: Share of slot values that must map one to one.
LEAST_CONSISTENT = 0.8
#: Bits of the table that lets windows pass; its size does not depend on the benchmark.
BITS = 23
#: Benchmark windows up to which the join is a broadcast.
MOST_BROADCAST = 200_000
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[%$€£¥°]|[.!?\n]")
# fixed values: units that may follow a number
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros mph kmh hz khz mhz v w kw kwh j kj percent degree degrees % $ € £ ¥ °"
)
LITERAL, NUMBER, CAPITAL, UNIT, STOP = range(5)
EXACT_READING = 2
MARKS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
FACTORS = (np.random.default_rng(5).integers(1, 1 << 62, size=64, dtype=np.int64) * 2 + 1).astype(np.uint64)
#: Added to the ids of the exact reading, so that they equal no template's.
EXACT_MARK = np.uint64(0xD6E8FEB86659FD93)
#: Words that a partition keeps the class of; beyond them it starts anew.
MOST_KEPT = 200_000
#: Kinds of windows: enough literal tokens, exact tokens, too few literal tokens.
TEMPLATE, EXACT, SPARSE = range(3)

BENCH_SCHEMA = "item_id long, item_pos int, total int, width int, kind int, hash long, item_slots array<string>"


class _Classes(dict):
    """token -> hash of its lower-case form with its class in the lowest three bits."""

    units = frozenset(UNITS.split())

    def __missing__(self, token: str) -> int:
        if token[0].isdigit():
            kind = NUMBER
        elif token in ".!?\n":
            kind = STOP
        elif token.lower() in self.units:
            kind = UNIT
        else:
            kind = CAPITAL if token[0].isupper() and not token[1:].isupper() else LITERAL
        if len(self) > MOST_KEPT:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~7 | kind
        return value


def templates(text: str, known: _Classes | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, and for both readings and the exact one the template ids and the literal flags (3 x n each).

    ``known`` keeps the classes of words for a partition.
    """
    found = TOKEN.findall(text)
    codes = np.fromiter(map((_Classes() if known is None else known).__getitem__, found), dtype=np.uint64, count=len(found))
    kind = (codes & np.uint64(7)).astype(np.int8)
    before = np.concatenate([[STOP], kind[:-1]]) if len(kind) else kind
    keep = kind != STOP
    tokens = [t for t, k in zip(found, keep.tolist(), strict=True) if k]
    codes, kind, before = codes[keep] & ~np.uint64(7), kind[keep], before[keep]
    ids, literal = np.empty((3, len(kind)), np.uint64), np.empty((3, len(kind)), bool)
    for reading in (0, 1):
        name = (kind == CAPITAL) & ((before != STOP) | bool(reading))
        unit, number = (kind == UNIT) & (before == NUMBER), kind == NUMBER
        literal[reading] = ~(name | unit | number)
        ids[reading] = np.where(name, MARKS[0], np.where(number, MARKS[1], np.where(unit, MARKS[2], codes)))
    ids[EXACT_READING], literal[EXACT_READING] = codes + EXACT_MARK, True
    return tokens, ids, literal


def window_hashes(ids: np.ndarray, literal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a reading, and which of them have enough literal tokens."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    total, plain = np.full(n, 0x27D4EB2F165667C5 ^ width, np.uint64), np.zeros(n, np.int16)
    for k in range(width):
        total += ids[k : k + n] * FACTORS[k]
        plain += literal[k : k + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total, plain >= min(LEAST_LITERAL, width)


def slot_values(tokens: list[str], literal: np.ndarray, at: int, width: int) -> list[str]:
    return [tokens[i].lower() for i in range(at, at + width) if not literal[i]]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> its windows: templates in both readings, exact ones where a reading has too few literal tokens."""

    @releasing
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Classes()
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                tokens, ids, literal = templates(text, known)
                width = min(WINDOW, len(tokens))
                if not width:
                    continue
                made = [window_hashes(ids[r], literal[r], width) for r in (0, 1, EXACT_READING)]
                total, sparse = len(tokens) - width + 1, ~(made[0][1] & made[1][1])
                # without a template of its own, an item is found by exact windows only
                whole = bool((made[0][1] | made[1][1]).any())
                seen = set()
                for r, (hashes, good) in enumerate(made):
                    for at in np.flatnonzero(sparse if r == EXACT_READING else good | whole).tolist():
                        h = int(hashes[at].astype(np.int64))
                        if (at, h) not in seen:
                            seen.add((at, h))
                            kind = EXACT if r == EXACT_READING else TEMPLATE if good[at] else SPARSE
                            out.append((item, at, total, width, kind, h, slot_values(tokens, literal[r], at, width)))
            yield pd.DataFrame(out, columns=["item_id", "item_pos", "total", "width", "kind", "hash", "item_slots"])

    return benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").mapInPandas(cut, BENCH_SCHEMA)


def bit_table(windows: DataFrame) -> np.ndarray:
    """Flags by the leading bits of the hash; the driver gets one number per 32 flags at most."""
    slots = windows.select(F.shiftrightunsigned("hash", 64 - BITS).alias("slot"))
    rows = slots.groupBy(F.expr("shiftright(slot, 5)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits")).collect()
    words = np.zeros(1 << (BITS - 5), np.uint32)
    for r in rows:
        words[r["at"]] = r["bits"]
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, covered, total, coverage, reparameterised, slots) of every leaked item."""
    spark = docs.sparkSession
    bench = cut_lineage(benchmark_windows(benchmark))
    # a few rows: one for each width and kind
    counts = {(r["width"], r["kind"]): r["count"] for r in bench.groupBy("width", "kind").count().collect()}
    table = spark.sparkContext.broadcast(np.packbits(bit_table(bench)))
    widths = sorted({w for w, _ in counts})
    any_sparse = any(kind == SPARSE for _, kind in counts)

    @releasing
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, known = np.unpackbits(table.value).astype(bool), _Classes()
        for pdf in batches:
            out = []
            for doc, key, text in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], strict=True):
                tokens, ids, literal = templates(text, known)
                for width in widths:
                    seen, sparse, strong = set(), [], False
                    for r in (0, 1, EXACT_READING) if (width, EXACT) in counts else (0, 1):
                        hashes, good = window_hashes(ids[r], literal[r], width)
                        for at in np.flatnonzero(flags[hashes >> np.uint64(64 - BITS)]).tolist():
                            h = int(hashes[at].astype(np.int64))
                            if (at, h) in seen:
                                continue
                            seen.add((at, h))
                            kind = EXACT if r == EXACT_READING else TEMPLATE if good[at] else SPARSE
                            strong |= kind == TEMPLATE
                            (sparse if kind == SPARSE else out).append((doc, key, at, kind, h, slot_values(tokens, literal[r], at, width)))
                    if strong:
                        out += sparse
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "pos", "kind", "hash", "slots"]).astype({"doc_id": "Int64"})

    keyed = docs.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("text_key"), "text")
    found = keyed.mapInPandas(match, "doc_id long, text_key string, pos int, kind int, hash long, slots array<string>")
    if any_sparse:
        found = cut_lineage(found)
    windows = bench.where(F.col("kind") != SPARSE).drop("width")
    if sum(n for (_, kind), n in counts.items() if kind != SPARSE) <= MOST_BROADCAST:
        windows = F.broadcast(windows)
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda x: F.struct(x["item_slots"].alias("item"), x["slots"].alias("doc")))
    hits = found.where(F.col("kind") != SPARSE).join(windows, ["hash", "kind"]).select(
        "doc_id", "text_key", "item_id", "total", "item_pos", "kind", (F.col("pos") - F.col("item_pos")).alias("shift"), pairs.alias("pairs"))
    # a diagonal holds at most as many windows as its item
    gathered = [F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")]
    lines = hits.groupBy("doc_id", "text_key", "item_id", "total", "shift").agg(*gathered, F.bool_or(F.col("kind") == TEMPLATE).alias("strong"))
    if any_sparse:
        lines = with_sparse(cut_lineage(lines), found, bench, pairs, gathered)
    size = F.size("pairs")
    one_to_one = F.least(F.size(F.array_distinct(F.col("pairs.item"))), F.size(F.array_distinct(F.col("pairs.doc"))))
    lines = lines.where(one_to_one >= LEAST_CONSISTENT * size)
    leaks = lines.groupBy("doc_id", "text_key", "item_id", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("covered"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots"))
    enough = (F.col("covered") >= LEAST_SHARE * F.col("total")) | (F.col("covered") >= LEAST_WINDOWS)
    return leaks.where(enough).select(
        "doc_id", "text_key", "item_id", "covered", "total", (F.col("covered") / F.col("total")).alias("coverage"),
        F.exists("slots", lambda s: s["item"] != s["doc"]).alias("reparameterised"), "slots")


def with_sparse(lines: DataFrame, found: DataFrame, bench: DataFrame, pairs: Column, gathered: list[Column]) -> DataFrame:
    """``lines`` with the windows of few literal tokens on diagonals that hold a template of the item.

    They are looked up by place, so there are at most as many as the item has windows for each diagonal.
    """
    keys = ["text_key", "item_id", "total", "shift"]
    places = lines.where("strong").select(*keys).distinct().join(bench.where(F.col("kind") == SPARSE), ["item_id", "total"]).withColumn(
        "pos", F.col("item_pos") + F.col("shift"))
    own = found.where(F.col("kind") == SPARSE).dropDuplicates(["text_key", "pos", "hash"]).select("text_key", "pos", "hash", "slots")
    more = places.join(own, ["text_key", "pos", "hash"]).withColumn("pairs", pairs).groupBy(*keys).agg(*gathered)
    more = more.withColumnsRenamed({"at": "more_at", "pairs": "more_pairs"})
    both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.array_union(a, b)).alias(a)
    return lines.join(more, keys, "left").select("doc_id", *keys, both("at", "more_at"), both("pairs", "more_pairs"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents whose text leaks no item. The verdict depends on the text alone, so the join is by its digest."""
    (key,) = fresh(docs, "text_key")
    leaked = find_leaks(docs, benchmark).select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, F.md5("text")).join(leaked, key, "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and leaked benchmark item."""
    return find_leaks(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "covered", "total", "coverage", "reparameterised")
