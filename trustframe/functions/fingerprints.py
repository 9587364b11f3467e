"""Stable identifiers and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.text import collapse_ws, nfkc, slug


def short_sha(parts: list[Column], length: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def stable_id(country: Column, source_class: Column, name: Column, branch: Column) -> Column:
    return F.concat_ws(
        "-", F.lower(country), slug(name), short_sha([country, source_class, name, branch], 8)
    )


def source_id(kind: Column, url: Column) -> Column:
    return F.concat_ws("-", F.lit("source"), kind, short_sha([kind, url], 12))


def fact_fingerprint(category: Column, text: Column, normalized: bool = False) -> Column:
    """``sha256:`` + 20 hex digits of ``category|text``; text is NFKC with single spaces."""
    body = text if normalized else collapse_ws(nfkc(text))
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("|", category, body), 256), 1, 20))


def json_fingerprint(json_text: Column) -> Column:
    """Digest of canonical JSON: variant text has sorted keys and no spaces."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.try_parse_json(json_text)), 256))


def row_digest(columns: list[str]) -> Column:
    """Digest of a row; NULL and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def report_fingerprint(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a row multiset, per ``keys`` or of the whole table.

    Row digests are added limb by limb (four 60-bit limbs in DECIMAL), so the work is a partial
    aggregate with a constant-size state: nothing is sorted and no group is collected.
    """
    digest = F.col("__digest")
    limbs = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"__limb{i}")
        for i in range(4)
    ]
    grouped = df.withColumn("__digest", row_digest(columns)).groupBy(*(keys or []))
    summed = grouped.agg(F.count(F.lit(1)).alias("row_count"), *limbs)
    text = F.concat_ws(
        ":", F.col("row_count").cast("string"),
        *[F.coalesce(F.col(f"__limb{i}"), F.lit(0).cast("decimal(30,0)")).cast("decimal(38,0)").cast("string") for i in range(4)],
    )
    return summed.select(*(keys or []), "row_count", F.sha2(text, 256).alias("fingerprint"))
