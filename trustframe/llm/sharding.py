"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows lie in chunks of at most ``chunk`` consecutive rows of one input partition. A matrix says how many rows of
each chunk go to each shard; its rows are draws without replacement from what the shards still hold, so the
sizes come out exactly and every assignment is equally likely. Each chunk permutes its rows by a seeded key, hands
them out by its row of the matrix (the exchange), and each shard permutes again to give the slots.

The matrix is drawn in two levels: the driver sees at most ``GROUPS`` sums, tasks draw the rows of one group.

Defined cases: NULLs and repeated rows are rows like any other; an empty table gives an empty result; columns
keep their names, and the added ``shard`` and ``slot`` replace columns of that name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustframe.llm.common import fresh
from trustframe.session import cut_lineage, load_table

#: Chunk sums that the driver sees at most.
GROUPS = 1024
#: numpy draws from populations below this size; larger ones are drawn by inversion.
NUMPY_MOST = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in ``sample`` draws without replacement."""
    if sample <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return sample
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    # inversion over +-40 standard deviations around the mode, from exact ratios of neighbouring probabilities
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mean = sample * good / total
    sd = math.sqrt(max(mean * (bad / total) * (total - sample) / (total - 1), 1.0))
    first, last = max(low, int(mean - 40 * sd)), min(high, int(mean + 40 * sd) + 1)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1]))


def draw_row(rng: np.random.Generator, left: list[int], rows: int) -> list[int]:
    """How many of ``rows`` go to each shard of which ``left`` places are free; ``left`` is lowered."""
    total, out = sum(left), []
    for j, places in enumerate(left):
        got = hypergeometric(rng, places, total - places, rows)
        total, rows = total - places, rows - got
        left[j] -= got
        out.append(got)
    return out


def shard_sizes(rows: int, shards: int, seed: int) -> list[int]:
    """Sizes at most one apart; a seeded draw says which shards are larger."""
    sizes = np.full(shards, rows // shards)
    sizes[np.random.default_rng(seed).permutation(shards)[: rows % shards]] += 1
    return [int(x) for x in sizes]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """counts(chunk, rows) -> (chunk, upto): running row counts by shard, drawn exactly."""
    spark = counts.sparkSession
    grouped = counts.withColumn("g", F.pmod(F.xxhash64("chunk"), F.lit(GROUPS)).cast("int"))
    sums = sorted((r["g"], r["rows"]) for r in grouped.groupBy("g").agg(F.sum("rows").alias("rows")).collect())
    left = shard_sizes(sum(n for _, n in sums), shards, seed)
    rng = np.random.default_rng([seed, 1])
    upper = [(g, draw_row(rng, left, n)) for g, n in sums]
    level = spark.createDataFrame(upper, "g int, places array<long>")

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        own = np.random.default_rng([seed, 2, int(key[0])])
        free = [int(x) for x in pdf["places"].iloc[0]]
        return pd.DataFrame({"chunk": pdf["chunk"], "upto": [np.cumsum(draw_row(own, free, int(n))) for n in pdf["rows"]]})

    # the upper level has GROUPS rows at most
    return grouped.join(F.broadcast(level), "g").groupBy("g").applyInPandas(draw, "chunk long, upto array<long>")


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 20240301, chunk_bits: int = 12,
                        block_rows: int = 1 << 10) -> DataFrame:
    """``df`` with shard (0 to ``shards`` - 1, sizes at most one apart) and slot (gapless from 0 in each shard).

    The table is written once with row numbers, so that a lost executor cannot renumber rows between the steps.
    """
    df = df.drop("shard", "slot")
    tag, chunk, place, upto, key, block = fresh(df, "row_tag", "chunk", "place", "upto", "key", "block")
    tagged = cut_lineage(df.withColumn(tag, F.monotonically_increasing_id()))
    rows = tagged.select(F.col(tag), F.shiftright(F.col(tag), chunk_bits).alias(chunk))
    counts = rows.groupBy(F.col(chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("rows"))
    matrix = communication_matrix(counts, shards, seed).select(F.col("chunk").alias(chunk), F.col("upto").alias(upto))
    local = Window.partitionBy(chunk).orderBy(F.xxhash64(F.col(tag), F.lit(seed)), F.col(tag))
    # a chunk belongs to one shard count row, so the join keeps one row per row
    dealt = rows.withColumn(place, F.row_number().over(local) - 1).join(matrix, chunk)
    blocks = max(1, math.ceil(tagged.count() / shards / block_rows))
    second = F.xxhash64(F.col(tag), F.lit(seed + 1))
    placed = cut_lineage(dealt.select(
        tag, F.size(F.filter(F.col(upto), lambda c: c <= F.col(place))).alias("shard"), second.alias(key),
        F.pmod(second, F.lit(blocks)).cast("int").alias(block)))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", block).agg(F.count(F.lit(1)).alias(place)).select(
        "shard", block, F.coalesce(F.sum(place).over(before), F.lit(0)).alias(upto))
    again = Window.partitionBy("shard", block).orderBy(key, tag)
    slots = placed.withColumn(place, F.row_number().over(again) - 1).join(starts, ["shard", block]).select(
        tag, "shard", (F.col(place) + F.col(upto)).alias("slot"))
    return tagged.join(slots, tag).drop(tag)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    shards = sharded.select("shard").distinct().count()
    sharded.repartitionByRange(max(1, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.mode(
        "overwrite").partitionBy("shard").parquet(path)


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``; a NULL text has size 1 and the checksum of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
