"""Order-sensitive operators written so that one hot key never lands in one task.

Plain window functions put a whole key into one task. Here the order column is cut into blocks that
are a fixed function of the data (a day, a number range). Work inside a block is a window over
(key, block); what earlier blocks contribute comes from a small table of block totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def join_back(df: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on the group keys (NULL keys are one group); AQE splits a skewed side."""
    renamed = summary
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
    cond = None
    for k in keys:
        part = df[k].eqNullSafe(renamed[f"__k_{k}"])
        cond = part if cond is None else cond & part
    return df.join(renamed, cond, how).drop(*[f"__k_{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], block: Column,
            sums: dict[str, Column] | None = None, row_number: str | None = None) -> DataFrame:
    """Row number and running sums per key, in order, without one task per key.

    ``block`` must not decrease along ``order_by`` and must not depend on anything but the row.
    """
    sums = dict(sums or {})
    if row_number:
        sums[row_number] = F.lit(1).cast("bigint")
    staged = df.withColumn("__block", block)
    for name, value in sums.items():
        staged = staged.withColumn(f"__in_{name}", value)
    local = Window.partitionBy(*keys, "__block").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    inner = staged
    for name in sums:
        inner = inner.withColumn(f"__run_{name}", F.sum(f"__in_{name}").over(local))
    totals = staged.groupBy(*keys, "__block").agg(*[F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__block", *[F.coalesce(F.sum(f"__tot_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums]
    )
    out = join_back(inner, offsets, [*keys, "__block"])
    for name in sums:
        out = out.withColumn(name, F.col(f"__run_{name}") + F.col(f"__off_{name}"))
    return out.select(*df.columns, *sums)


def occurrence_number(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], block: Column,
                      name: str = "occurrence") -> DataFrame:
    """1, 2, 3 … per key in order (the ``[n]`` of a repeated selector, attempt numbers)."""
    return running(df, keys, order_by, block, row_number=name)


def duplicate_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Second and later rows of each key with the position of the first (``first_ord``).

    ``order`` must be unique within a key. A partial ``min`` replaces the window.
    """
    groups = df.groupBy(*keys).agg(F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("__n"))
    repeated = groups.filter(F.col("__n") > 1).drop("__n")
    return join_back(df, repeated, keys).filter(F.col(order) != F.col("first_ord"))


def deviating_rows(df: DataFrame, keys: Sequence[str], order: str, compare: Sequence[str],
                   comparable: Column | None = None) -> DataFrame:
    """Rows that differ from the first comparable row of their key; baseline columns are added as ``base_*``."""
    rows = df if comparable is None else df.filter(comparable)
    base = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in compare]), F.col(order)).alias("__base"),
        F.count(F.lit(1)).alias("__n"),
    ).filter(F.col("__n") > 1)
    joined = join_back(rows, base, keys)
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__base.{c}"))
    flat = joined.filter(differs).select(
        *rows.columns, *[F.col(f"__base.{c}").alias(f"base_{c}") for c in compare]
    )
    return flat


def last_write_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the latest row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return best.select(*keys, "__last.*").select(*df.columns)


def last_n(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int) -> DataFrame:
    """Last ``n`` rows per key. ``order_by`` is descending; the rank limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def lagged(df: DataFrame, keys: Sequence[str], sequence: str, block: Column, values: dict[str, str]) -> DataFrame:
    """Previous row's values per key (``name -> column``), plus ``is_first``, ``is_last``, ``group_rows``.

    Inside a block this is ``lag``; the first row of a block takes the last row of the block before.
    """
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    staged = df.withColumn("__block", block).withColumn("__v", packed)
    local = Window.partitionBy(*keys, "__block").orderBy(sequence)
    inner = staged.withColumn("__lag", F.lag("__v").over(local))
    ends = staged.groupBy(*keys, "__block").agg(F.max_by("__v", sequence).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__block")
    ends = ends.select(*keys, "__block", F.lag("__end").over(before).alias("__prev"))
    spans = df.groupBy(*keys).agg(
        F.min(sequence).alias("__lo"), F.max(sequence).alias("__hi"), F.count(F.lit(1)).alias("group_rows")
    )
    out = join_back(join_back(inner, ends, [*keys, "__block"]), spans, keys)
    last = F.coalesce("__lag", "__prev")
    return out.select(
        *df.columns, *[last[n].alias(n) for n in values], (F.col(sequence) == F.col("__lo")).alias("is_first"),
        (F.col(sequence) == F.col("__hi")).alias("is_last"), "group_rows",
    )


def order_violations(df: DataFrame, keys: Sequence[str], sequence: str, moment: str, block: Column) -> DataFrame:
    """Rows earlier than some row before them in sequence; per block first, then across blocks."""
    staged = df.withColumn("__block", block)
    local = Window.partitionBy(*keys, "__block").orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    inner = staged.withColumn("__seen", F.max(moment).over(local))
    tops = staged.groupBy(*keys, "__block").agg(F.max(moment).alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*keys, "__block", F.max("__top").over(before).alias("__before"))
    out = join_back(inner, offsets, [*keys, "__block"])
    latest = F.greatest(F.col("__seen"), F.col("__before"))
    return out.filter(F.col(moment) < latest).select(*df.columns)


def newest_cohort_guard(df: DataFrame, keys: Sequence[str], cohort: str) -> DataFrame:
    """Rows with a later dated cohort among the rows of the same keys (``newest`` is that cohort)."""
    top = df.groupBy(*keys).agg(F.max(cohort).alias("newest"))
    return join_back(df, top, keys).filter(F.col(cohort) < F.col("newest"))
