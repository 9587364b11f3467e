"""Sources and sinks driven by the standard tables: written to the shared folder, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import variants
from trustframe.plans.registry import plan
from trustframe.session import checkpoint_root, load_table
from trustframe.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@plan("registry_roundtrip", """
SELECT p_partkey, p_partkey % 500 AS ord, p_name AS name, 'number' AS value_type, CAST(p_size AS VARCHAR) AS value FROM part
""")
def registry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON registries of 500 claims each, read back by the strict reader."""
    p = load_table(spark, sf_dir, "part")
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("value"))
    docs = p.groupBy(F.floor(F.col("p_partkey") / 500).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("claims"))
    body = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit("2026-07-19T00:00:00Z").alias("generatedAt"), F.col("claims")))
    path = _folder(spark, "registry")
    docs.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = readers.read_registry(spark, path, "claims")
    value = F.try_variant_get("row", "$.value", "variant")
    return rows.select(
        F.try_variant_get("row", "$.id", "bigint").alias("p_partkey"), "ord", F.try_variant_get("row", "$.name", "string").alias("name"),
        variants.json_type(value).alias("value_type"), variants.scalar_text(value).alias("value"),
    )


@plan("csv_strict", """
SELECT 'rows' AS what, CAST(p_partkey AS VARCHAR) || '|' || p_name || '|' || p_brand AS value FROM part
""")
def csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as CSV files of at most 200 rows; bounds hold, so no issue rows appear."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    path = _folder(spark, "csv")
    p.write.option("maxRecordsPerFile", 200).csv(path)
    rows, issues = readers.read_csv_strict(spark, path, "utf-8")
    return rows.select(F.lit("rows").alias("what"), F.array_join("cells", "|").alias("value")).unionByName(
        issues.select(F.col("code").alias("what"), F.col("entity_id").alias("value"))
    )


@plan("publish_check", """
SELECT c_nationkey AS nation, count(*) AS declared, CAST(0 AS BIGINT) AS stale_rows FROM customer GROUP BY 1
""")
def publish_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers published per nation with their meta table, then checked against a rebuild."""
    c = load_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name", "c_mktsegment")
    path = _folder(spark, "asset")
    writers.publish_partitions(c, path, F.lit("2026-07-19"), by="nation")
    published = spark.read.parquet(f"{path}/rows")
    stale = writers.stale_rows(published, c, ["nation", "c_custkey", "c_name", "c_mktsegment"])
    bad = stale.groupBy("nation").agg(F.sum("copies").alias("stale_rows"))
    meta = spark.read.parquet(f"{path}/meta")
    return meta.join(bad, "nation", "left").select("nation", F.col("count").alias("declared"), F.coalesce("stale_rows", F.lit(0)).cast("bigint").alias("stale_rows"))


@plan("same_output", "SELECT true AS reordered, false AS changed")
def same_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reordered copy has the same fingerprint; a copy without one status does not."""
    o = load_table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    a = writers.same_output(o, o.repartition(5, "o_custkey"), cols)
    b = writers.same_output(o, o.filter("o_orderstatus <> 'F'"), cols)
    return a.select(F.col("same").alias("reordered"), b.select("same").scalar().alias("changed"))


@plan("issue_report", """
SELECT o_orderstatus AS code, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O','F') GROUP BY 1
""")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues written as an ordered report with its summary, read back."""
    from trustframe.plans.registry_rules import order_rules

    path = _folder(spark, "report")
    issues = order_rules(load_table(spark, sf_dir, "orders")).filter("code = 'STATUS'")
    writers.write_report(issues, path, "parquet")
    back = spark.read.parquet(f"{path}/issues")
    return back.groupBy(F.col("actual").alias("code")).agg(F.count(F.lit(1)).alias("n"))
