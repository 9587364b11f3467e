"""Joins on buckets of which some hold a great part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.session import spread

#: Rows of a side that meet in one task, on average; a merge holds so many of one key without a sorter.
_BLOCK = 2048
BLOCKS = ("__left_block", "__right_block")


def in_blocks(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], left_hash: Sequence[str],
              right_hash: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt over all tasks for a join of ``left_on`` with ``right_on``; join them by ``same_blocks``, too.

    A full bucket is cut into blocks by the hashed columns, and each two blocks meet in a task of their own, so that few keys
    with many rows use all tasks. Rows that are equal in the hashed columns share a block. The right side asks for a
    merge: a broadcast would leave all pairs to the few tasks that read the other table.
    """
    keys, counts = [f"__k{i}" for i in range(len(left_on))], ("__left_n", "__right_n")

    def sizes(rows: DataFrame, on: Sequence[str], count: str) -> DataFrame:
        return rows.groupBy(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]).agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias(count))

    blocks = sizes(left, left_on, counts[0]).join(sizes(right, right_on, counts[1]), keys)
    full = F.broadcast(blocks.filter(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in counts])))  # bounded: a row for thousands of theirs

    def dealt(rows: DataFrame, on: Sequence[str], columns: Sequence[str], own: int) -> DataFrame:
        same = reduce(and_, [F.col(c) == F.col(k) for c, k in zip(on, keys, strict=True)])
        mine, other = (F.coalesce(F.col(counts[i]), F.lit(1)) for i in (own, 1 - own))
        hashed = [c for c in columns if not any(t in rows.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
        block = F.pmod(F.xxhash64(*hashed), mine).alias(BLOCKS[own])
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1)).alias(BLOCKS[1 - own])
        return spread(rows.join(full, same, "left").select(*rows.columns, block, others), *on, *BLOCKS)

    return dealt(left, left_on, left_hash, 0).alias("a"), dealt(right, right_on, right_hash, 1).hint("merge").alias("b")


def same_blocks() -> Column:
    return reduce(and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in BLOCKS])
