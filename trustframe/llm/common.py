"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but a blank and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with ``names`` and clash with no column of ``df`` (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on the batches of a partition; then the memory that it has freed goes back to the system.

    Workers live on, several to a core, and an idle one would hold what its last task needed beside those that work.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % modulus


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Classes whose counts are few enough for the driver and a broadcast.
MOST_CLASSES = 10_000


def bounded_sample(df: DataFrame, by: str, per_class: int, identity: Iterable[str]) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by a hash of ``identity``.

    All rows are counted; the share kept of a class is ``per_class`` over its count, so the sample's size is
    bounded whatever the input, and a rerun takes the same rows. Classes that are smaller stay whole, NULL is none. Up to
    ``MOST_CLASSES`` counts are sent to the rows; with more of them the rows go to the counts.
    """
    (n,) = fresh(df, "n")
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(n))
    few = counts.limit(MOST_CLASSES + 1).collect()
    if len(few) <= MOST_CLASSES:
        counts = F.broadcast(df.sparkSession.createDataFrame(few, counts.schema))
    unit = F.pmod(F.xxhash64(*[F.col(c) for c in identity], F.lit(20240229)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(counts, by).where(unit < F.lit(float(per_class)) / F.col(n)).select(*df.columns)


#: Bits of a table of hashes; fixed, so it is broadcast whatever the input is.
BITS = 23


def flags_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bit table by the leading bits of a hash; the driver gets one number per 32 bits at most."""
    slots = keys.select(F.shiftrightunsigned(column, 64 - BITS).alias("slot"))
    rows = slots.groupBy(F.expr("shiftright(slot, 5)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits")).collect()
    words = np.zeros(1 << (BITS - 5), np.uint32)
    for r in rows:
        words[r["at"]] = r["bits"]
    return words.view(np.uint8)


def read_flags(table: np.ndarray) -> np.ndarray:
    return np.unpackbits(table, bitorder="little").astype(bool)


def may_hold(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose hash ``key`` may be among ``wanted`` (one column h): none that is gets lost, some others stay.

    It thins a side of an equi join before its shuffle. The table has a fixed size; with far more keys than it has bits, all
    rows stay and the join is a plain one.
    """
    table = df.sparkSession.sparkContext.broadcast(flags_of(wanted, "h"))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = read_flags(table.value)
        for h in batches:
            yield pd.Series(flags[h.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BITS)])

    return df.where(known(key))
