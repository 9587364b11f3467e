"""Report sinks, partitioned publication and derived-output checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.fingerprints import report_fingerprint
from trustframe.operators.reconcile import set_difference

REPORT_ORDER = ("check", "code", "entity_id", "field", "actual")


def ordered_report(issues: DataFrame, order: Sequence[str] = REPORT_ORDER) -> DataFrame:
    """Total order of a report, used only where it is written (a range-partitioned sort)."""
    return issues.orderBy(*order)


def write_report(issues: DataFrame, path: str, fmt: str = "json", order: Sequence[str] = REPORT_ORDER) -> None:
    """Issues in report order plus a summary next to them."""
    ordered_report(issues, order).write.mode("overwrite").format(fmt).save(f"{path}/issues")
    issues.groupBy("check", "code").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(fmt).save(f"{path}/summary")


def publish_partitions(df: DataFrame, path: str, generated_at: Column, by: str = "country",
                       schema_version: int = 1) -> None:
    """One folder per ``by`` value plus a meta table (schema_version, generated_at, count)."""
    df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/rows")
    meta = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    meta.select(by, F.lit(schema_version).alias("schema_version"), generated_at.alias("generated_at"), "count").write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")


def stale_rows(actual: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that make a published output stale: in one of the tables only, with copies."""
    return set_difference(actual, expected, columns)


def same_output(actual: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (same): order-free fingerprints of both tables compared."""
    parts = [report_fingerprint(df, list(columns)).select("fingerprint") for df in (actual, expected)]
    both = parts[0].unionByName(parts[1])
    return both.agg((F.countDistinct("fingerprint") == 1).alias("same"))
