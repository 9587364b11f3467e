"""Importance resampling towards a target distribution: array-scored weights and a distributed quickselect.

1. Features are runs of one and two words, hashed into buckets. Counts of all documents' and all target texts'
   features give one gain per bucket: an array of fixed length, which scores a document's buckets in place.
2. A document's score is its mean gain plus Gumbel noise from its id, so the highest scores are a draw without
   replacement.
3. Quickselect: the keys (score, id, ...) of a round's rows are counted below, at and above random pivot keys in one
   pass; only the rows between the two pivots around the k-th stay for the next round. No row is sorted for it.
4. The winners alone are range-partitioned, sorted and ranked; all other rows pass by.

Defined cases: a NULL or empty text has no feature and weight 0; NULL ids are hashed as empty and come last among
ties; rows with equal score and id are told apart by features, text and then row number, so exactly k rows win;
an empty target or input gives gains from the added ones alone; columns of the input that clash with the new ones are
kept and the new ones get a trailing underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from trustframe.llm.common import fresh
from trustframe.session import cut_lineage, load_table, release

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25
SEED = 7
#: Pivot keys of a round; a round leaves about one part in so many.
PIVOTS = 24


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def buckets_of(words: Column) -> Column:
    """Buckets of all words and of all pairs of neighbours, repeats kept."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.transform(F.concat(words, pairs), lambda f: (F.crc32(f.cast("binary")) % BUCKETS).cast("int"))


def bucket_counts(df: DataFrame, buckets: str, name: str) -> DataFrame:
    return df.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """Gain of every bucket from tables with an array column ``buckets``: BUCKETS numbers, whatever the input."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_counts(source, "buckets", "s"), "bucket", "left").join(bucket_counts(target, "buckets", "t"), "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = cut_lineage(rows)
    total = rows.agg(F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * F.lit(total["S"] + BUCKETS) / ((s + 1.0) * F.lit(total["T"] + BUCKETS))
    found = rows.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain")).collect()  # BUCKETS rows
    release(rows)
    return [r["gain"] for r in sorted(found)]


def noise(identity: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> written table (doc_id, n_words, n_features, weight, score, th, tag); a text is read once."""
    def featured(df: DataFrame, *kept: Column) -> DataFrame:
        words = df.select(*kept, words_of(F.col("text")).alias("words"))
        return words.select(*[c for c in words.columns if c != "words"], F.size("words").alias("n_words"), buckets_of(F.col("words")).alias("buckets"))

    source = cut_lineage(featured(docs, F.col("doc_id"), F.xxhash64("text").alias("th")))
    wanted = cut_lineage(featured(target))
    table = F.split(F.lit(",".join(map(str, gains(source, wanted)))), ",").cast("array<long>")  # folded to one literal
    n = F.size("buckets").cast("long")
    made = source.withColumns({"n_features": n, "sum": F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))})
    # the sum less its remainder divides evenly, so the quotient is the floor
    made = made.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long")))
    made = made.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "tag": F.monotonically_increasing_id()})
    out = cut_lineage(made.select("doc_id", "n_words", "n_features", "weight", "score", "th", "tag"))
    release(source, wanted)
    return out


@dataclass(frozen=True)
class Order:
    """A total order of rows: columns, each ascending or descending, NULL last; the last ones make keys unique."""

    by: tuple[tuple[str, bool], ...]

    @property
    def key(self) -> Column:
        """A struct that sorts as the order does."""
        parts = []
        for i, (name, descending) in enumerate(self.by):
            parts += [F.col(name).isNull().alias(f"x{i}"), (-F.col(name) if descending else F.col(name)).alias(f"k{i}")]
        return F.struct(*parts)

    @staticmethod
    def literal(key: Row, schema) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, schema, strict=True)])


def kth_key(rows: DataFrame, order: Order, k: int, pivots: int = PIVOTS) -> Column:
    """The k-th (from 1) key of a written table by quickselect; its length must be k at least."""
    now = rows.select(order.key.alias("key"))
    schema, turn, held = now.schema["key"].dataType, 0, None
    while True:
        turn += 1
        chosen = now.orderBy(F.xxhash64("key", F.lit(turn))).limit(pivots).select("key").distinct().orderBy("key").collect()
        keys = [Order.literal(r["key"], schema) for r in chosen]
        below = [F.count(F.when(F.col("key") < p, 1)).alias(f"b{i}") for i, p in enumerate(keys)]
        at = [F.count(F.when(F.col("key") == p, 1)).alias(f"a{i}") for i, p in enumerate(keys)]
        counts = now.agg(*below, *at).first()
        low = high = None
        left = k
        for i, p in enumerate(keys):
            before, own = counts[f"b{i}"], counts[f"a{i}"]
            if before < k <= before + own:
                release(held)
                return p
            if k <= before:
                high = p
                break
            low, left = p, k - before - own
        if low is not None:
            now = now.where(F.col("key") > low)
        if high is not None:
            now = now.where(F.col("key") < high)
        k, before_now = left, held
        held = now = cut_lineage(now)
        release(before_now)


def ranked(winners: DataFrame, order: Order, rank: str) -> DataFrame:
    """``winners`` with their places from 1, in parallel: range partitions, sorted, each after the rows of those before."""
    at, part, n, start = fresh(winners, "at", "part", "n", "start")
    sort = [(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last()) for c, d in order.by]
    count = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id holds the partition and the row's place in it
    laid = cut_lineage(winners.repartitionByRange(count, *sort).sortWithinPartitions(*sort).withColumn(at, F.monotonically_increasing_id()))
    split = laid.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted(split.groupBy(part).agg(F.count(F.lit(1)).alias(n)).collect())  # one row a partition
    starts, total = [], 0
    for p, size in sizes:
        starts.append((p, total))
        total += size
    first = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]).cast("map<bigint,bigint>"), F.col(part)) if starts else F.lit(0)
    return split.withColumn(rank, (first + F.col(at) + 1).cast("long")).drop(at, part)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> (doc_id, n_features, weight, score, rank); rank is NULL for those not drawn."""
    base = scored(docs.select("doc_id", "text"), target.select("text"), seed)
    order = Order((("score", True), ("doc_id", False), ("n_features", False), ("th", False), ("tag", False)))
    able = base.where(F.col("n_words") >= least_words)
    k = share * able.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long").alias("rank")
    if not k:
        return base.select(*out, nothing)
    last = kth_key(able, order, k)
    wins = (F.col("n_words") >= least_words) & (order.key <= last)
    return ranked(base.where(wins), order, "rank").select(*out, "rank").union(base.where(~wins).select(*out, nothing))


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``docs`` of the drawn ids with their (best) ``rank``; rows that share a drawn id all come, NULL ids do not."""
    rank, own = fresh(docs, "rank", "own_id")
    drawn = resample(docs, target, **options).where("rank is not null").groupBy(F.col("doc_id").alias(own)).agg(F.min("rank").alias(rank))
    return docs.join(drawn, F.col("doc_id") == F.col(own)).drop(own)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and, if drawn towards the benchmark's texts, its place in the draw."""
    return resample(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))

