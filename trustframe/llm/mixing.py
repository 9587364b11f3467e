"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

1. Targets: sources weigh 5, 2, 1, repeating in code point order (NULL last), and share all words by weight; a
   target stops at three times its source's words and the excess is shared again. Sorted by cap over weight, the
   capped sources are a prefix, so running sums give the level at once.
2. All words are cut into equal blocks; the blocks go to the sources by the highest quotients target / (2k + 1),
   then a source's blocks to its shards (seeded groups of documents) in the same way: integer quotas per shard.
3. In a shard the documents lie one after another in a seeded order. A quota takes every block some whole number
   of times and, once more, a run of blocks from a seeded start. A document takes the words of its own that the
   taken blocks cover.

Defined cases: a NULL or empty text has no words and takes none; NULL is a source of its own, the last one;
repeated rows are taken independently; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustframe.llm.common import fresh, n_words
from trustframe.session import cut_lineage, load_table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Blocks that all words are cut into, about.
BLOCKS = 1 << 20
#: Documents of a shard, about.
SHARD_ROWS = 1 << 12
SEED = 20240302


def sainte_lague(units: DataFrame, group: list[str], order: list[str], votes: Column, seats: Column, most: Column,
                 out: str) -> DataFrame:
    """``units`` with ``out``: seats by the highest quotients votes / (2k + 1) in each group, ``most`` at most.

    Shares are taken of what the full units (those at ``most``) leave: sorted by most over votes they are a prefix, so
    running sums give the level at once. Rounded shares are off by half a seat per unit at most, so only the next
    quotients of each unit, about one and a half times its share of the units, can move: a number of rows linear in the units.
    Seats that no unit may take are left.
    """
    part = group or [F.lit(0)]
    whole = Window.partitionBy(*part)
    named = units if out.lower() in {c.lower() for c in units.columns} else units.withColumn(out, F.lit(0))
    v, s, m, first, off, reach, k, q, at = fresh(named, "v", "s", "m", "first", "off", "reach", "k", "q", "at")
    base = units.withColumns({v: votes.cast("double"), s: seats.cast("long"), m: F.greatest(most.cast("long"), F.lit(0))})
    base = base.withColumn(k, F.when(F.col(v) > 0, F.col(m) / F.col(v)).otherwise(F.lit(float("inf"))))
    before = Window.partitionBy(*part).orderBy(k, *order).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(v).over(whole) - F.coalesce(F.sum(v).over(before), F.lit(0.0))
    level = F.when(rest > 0, (F.col(s) - F.coalesce(F.sum(m).over(before), F.lit(0))) / rest)
    base = base.withColumn(q, level)
    open_ = F.col(k) >= F.col(q)
    base = base.withColumn(q, F.min_by(F.when(open_, F.col(q)), F.when(open_, F.struct(k, *order))).over(whole))
    share = F.when(F.col(v) <= 0, F.lit(0)).when(F.col(q).isNull(), F.col(m)).otherwise(F.floor(F.col(q) * F.col(v) + 0.5))
    base = base.withColumn(first, F.greatest(F.lit(0), F.least(F.col(m), share)).cast("long"))
    # the votes and the number of units below their most
    below = F.col(first) < F.col(m)
    base = base.withColumns({at: F.count(F.lit(1)).over(whole), k: F.sum(F.when(below, F.col(v))).over(whole)})
    base = base.withColumns({off: F.col(s) - F.sum(first).over(whole), q: F.row_number().over(Window.partitionBy(*part).orderBy(*order))})
    base = base.withColumn(reach, (F.ceil(F.coalesce(F.try_divide(F.col(v), F.col(k)), F.lit(0.0)) * F.col(at) * 1.5) + 2).cast("int"))
    up = F.col(off) > 0
    moves = base.where(F.col(off) != 0).select(
        *group, *order, off, m, v, F.when(up, F.col(q)).otherwise(-F.col(q)).alias(at), F.explode(F.sequence(F.lit(0), F.col(reach))).alias(k), first).withColumn(
        k, F.when(up, F.col(first) + F.col(k)).otherwise(F.col(first) - 1 - F.col(k)))
    moves = moves.where((F.col(k) >= 0) & (F.col(k) < F.col(m)) & (F.col(v) > 0)).withColumn(
        q, F.when(up, -F.col(v)).otherwise(F.col(v)) / (2 * F.col(k) + 1))
    # of equal quotients the first unit gets a seat, the last one gives it back
    ranked = moves.withColumn(at, F.row_number().over(Window.partitionBy(*part).orderBy(q, at, k)))
    moved = ranked.where(F.col(at) <= F.abs(off)).groupBy(*group, *order).agg(F.sum(F.signum(off)).cast("long").alias(q))
    return base.drop(q).join(moved, [*group, *order], "left").withColumn(
        out, F.col(first) + F.coalesce(F.col(q), F.lit(0))).drop(v, s, m, first, off, reach, k, q, at)


def source_targets(sources: DataFrame) -> DataFrame:
    """sources(skey, source_size, ...) -> with weight and target."""
    by_name = Window.partitionBy(F.lit(0)).orderBy("skey")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    named = sources.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    named = named.withColumns({"cap": MOST_REPEATS * F.col("source_size"), "ratio": MOST_REPEATS * F.col("source_size") / F.col("weight")})
    whole = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    named = named.withColumn("words", F.sum("source_size").over(whole))
    named = named.withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)))
    named = named.withColumn("level", F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "skey"))).over(whole))
    return named.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).drop("cap", "ratio", "level")


def mix(df: DataFrame, source: str, size: str, identity: list[str], blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS,
        seed: int = SEED) -> DataFrame:
    """``df`` (narrow) with source_size, target and taken; ``identity`` seeds the order of documents."""
    df = df.drop("source_size", "target", "taken")
    skey, h, shard, end, n, words, quota, held, again, extra, start, run = fresh(
        df, "skey", "h", "shard", "end", "n", "words", "quota", "held", "again", "extra", "start", "run")
    base = cut_lineage(df.withColumns({
        skey: F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1")), h: F.xxhash64(*identity, F.lit(seed))}))
    sources = source_targets(base.groupBy(F.col(skey).alias("skey")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows")))
    block = F.greatest(F.lit(1), F.floor(F.col("words") / blocks)).cast("long")
    sources = sources.withColumn("block", block)
    sources = sainte_lague(sources, [], ["skey"], F.col("target"), F.floor(F.col("words") / F.col("block")),
                           MOST_REPEATS * F.ceil(F.col("source_size") / F.col("block")), "seats")
    sources = cut_lineage(sources).select(
        F.col("skey").alias(skey), "source_size", "target", F.col("block").alias(n), F.col("seats").alias(quota),
        F.ceil(F.col("rows") / shard_rows).cast("long").alias(words))
    # xxhash64 of the order key again, so that shard and order are independent
    docs = base.join(sources, skey).withColumn(shard, F.pmod(F.xxhash64(F.col(h), F.lit(seed)), F.col(words)))
    shards = docs.groupBy(skey, shard).agg(F.sum(size).alias(held), F.first(n).alias(n), F.first(quota).alias(quota))
    shards = sainte_lague(shards, [skey], [shard], F.col(held), F.col(quota), MOST_REPEATS * F.ceil(F.col(held) / F.col(n)), "shard_seats")
    count = F.greatest(F.lit(1), F.ceil(F.col(held) / F.col(n))).cast("long")
    shards = shards.withColumn(words, count).select(
        skey, shard, held, F.col(n).alias(run), F.floor(F.col("shard_seats") / F.col(words)).cast("long").alias(again),
        (F.pmod(F.col("shard_seats"), F.col(words))).alias(extra),
        F.pmod(F.xxhash64(F.col(skey), F.col(shard), F.lit(seed + 1)), F.col(words)).alias(start), F.col(words).alias(quota))
    running = Window.partitionBy(skey, shard).orderBy(h, size).rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.drop(n, quota, words).withColumn(end, F.sum(size).over(running)).join(shards, [skey, shard])

    def covered(first: Column, last: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(end), last, F.col(held)) - F.greatest(F.col(end) - F.col(size), first))

    begin, stop, wrapped = F.col(start) * F.col(run), (F.col(start) + F.col(extra)) * F.col(run), (F.col(start) + F.col(extra) - F.col(quota)) * F.col(run)
    taken = F.col(again) * F.col(size) + covered(begin, stop) + covered(F.lit(0), wrapped)
    return docs.withColumn("taken", taken.cast("long")).drop(skey, h, shard, end, held, run, again, extra, start, quota)


def mixed_documents(docs: DataFrame, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The mix as documents: each row as often as its taken words fill it, to the nearest whole number.

    Texts are joined back by row number from one written table; documents without words take no part in a mix.
    """
    tag, size, copies = fresh(docs, "row_tag", "size", "copies")
    tagged = cut_lineage(docs.withColumns({tag: F.monotonically_increasing_id(), size: n_words(F.col("text"))}))
    narrow = tagged.select(tag, size, "source", "doc_id", F.xxhash64("text").alias("th"))
    mixed = mix(narrow, "source", size, ["doc_id", "th"], blocks, shard_rows)
    copied = mixed.select(tag, F.when(F.col(size) > 0, F.floor(F.col("taken") / F.col(size) + 0.5)).otherwise(0).cast("int").alias(copies)).where(F.col(copies) > 0)
    return tagged.join(copied, tag).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs, "source", "size", ["doc_id", "size"]).select("doc_id", "size", "source_size", "target", "taken")
