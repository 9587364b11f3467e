"""Lineage graph queries over part keys, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.operators import lineage as L
from trustframe.operators import reconcile as R
from trustframe.plans.registry import plan
from trustframe.session import load_table

GRAPH_SQL = """
WITH RECURSIVE edges AS (SELECT p_partkey AS claim_id, p_partkey // 2 AS input_id FROM part WHERE p_partkey >= 10 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 10),
bad(id) AS (SELECT CAST(p_partkey AS BIGINT) FROM part WHERE p_partkey = 7 UNION SELECT claim_id FROM edges JOIN bad ON input_id=id),
lev(id, level) AS (SELECT CAST(p_partkey AS BIGINT), 0 FROM part WHERE p_partkey < 10 UNION SELECT claim_id, level + 1 FROM edges JOIN lev ON input_id=id),
top AS (SELECT id, max(level) AS level FROM lev GROUP BY 1)
"""


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part from key 10 on is derived from the parts at half and at a third of its key."""
    p = load_table(spark, sf_dir, "part").filter("p_partkey >= 10").select("p_partkey")
    return p.select(
        F.col("p_partkey").alias("claim_id"),
        F.explode(F.array_distinct(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)))).alias("input_id"),
    )


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official parts; number 7 has no valid evidence."""
    return load_table(spark, sf_dir, "part").filter("p_partkey < 10 and p_partkey <> 7").select(F.col("p_partkey").alias("id"))


@plan("lineage_levels", GRAPH_SQL + """
SELECT DISTINCT claim_id, claim_id NOT IN (SELECT id FROM bad) AS executed, CASE WHEN claim_id NOT IN (SELECT id FROM bad) THEN level END AS level,
 (SELECT count(*) FROM edges e2 WHERE e2.claim_id=edges.claim_id AND e2.input_id IN (SELECT id FROM bad)) AS unmet_inputs FROM edges JOIN top ON claim_id=id
""")
def lineage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.execution_status(edges_of(spark, sf_dir), sources_of(spark, sf_dir))


@plan("lineage_cycles", """
WITH RECURSIVE edges AS (SELECT p_partkey AS claim_id, p_partkey // 2 AS input_id FROM part WHERE p_partkey >= 10 UNION SELECT max(p_partkey) // 8, max(p_partkey) // 4 FROM part),
cyc AS (SELECT max(p_partkey) // 8 AS a, max(p_partkey) // 4 AS b FROM part),
bad(id) AS (SELECT CAST(a AS BIGINT) FROM cyc UNION SELECT claim_id FROM edges JOIN bad ON input_id=id)
SELECT DISTINCT id AS claim_id FROM bad
""")
def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of halves closed into a cycle by one extra edge: everything behind it never runs."""
    p = load_table(spark, sf_dir, "part")
    base = p.filter("p_partkey >= 10").select(F.col("p_partkey").alias("claim_id"), F.floor(F.col("p_partkey") / 2).alias("input_id"))
    top = p.agg(F.max("p_partkey").alias("m"))
    extra = top.select(F.floor(F.col("m") / 8).alias("claim_id"), F.floor(F.col("m") / 4).alias("input_id"))
    return L.cyclic_claims(base.unionByName(extra))


@plan("lineage_audit", GRAPH_SQL + """
SELECT 'derived' AS metric, count(*) AS n FROM part WHERE p_partkey >= 10 UNION ALL SELECT 'mapped', count(DISTINCT claim_id) FROM edges
UNION ALL SELECT 'executed', count(DISTINCT claim_id) FROM edges WHERE claim_id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'inputs', count(DISTINCT input_id) FROM edges
UNION ALL SELECT 'remaining', count(DISTINCT id) FROM bad
""")
def lineage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sources = edges_of(spark, sf_dir), sources_of(spark, sf_dir)
    executed = L.topological_levels(edges, sources)
    claims = load_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("claim_id"), F.lit("critical").alias("severity"),
        F.when(F.col("p_partkey") >= 10, F.lit("derived")).otherwise(F.lit("official")).alias("status"),
    )
    remaining = L.remaining_critical(claims, sources.select(F.col("id").alias("claim_id")), executed)
    return L.lineage_audit(L.critical_scope(claims), edges, executed, remaining)


@plan("coverage_remaining", """
SELECT doc_id AS claim_id FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)
""")
def coverage_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("claim_id"), F.when(F.col("n_chars") > 500, F.lit("critical")).otherwise(F.lit("minor")).alias("severity")
    )
    lab = load_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), "quality", "toxic")
    return L.remaining_critical(d, lab.filter("quality = 1"), lab.filter("toxic = 1")).select("claim_id")


@plan("scope_difference", """
WITH a AS (SELECT doc_id AS claim_id FROM documents WHERE lang='en' AND n_chars > 500), b AS (SELECT doc_id AS claim_id FROM labels WHERE quality=1)
SELECT claim_id, 'left' AS side, CAST(1 AS BIGINT) AS copies FROM a WHERE claim_id NOT IN (SELECT claim_id FROM b) UNION ALL SELECT claim_id, 'right', 1 FROM b WHERE claim_id NOT IN (SELECT claim_id FROM a)
""")
def scope_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("claim_id"), F.when(F.col("lang") == "en", F.lit("derived")).otherwise(F.lit("official")).alias("status"),
        F.when(F.col("n_chars") > 500, F.lit("critical")).otherwise(F.lit("minor")).alias("severity"),
    )
    declared = load_table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("claim_id"))
    return R.set_difference(L.critical_scope(claims), declared, ["claim_id"])


@plan("negative_evidence", """
WITH g AS (SELECT user_id, count(*) AS cohort_rows, count(*) FILTER (WHERE value > 60) AS unwanted_rows, count(*) FILTER (WHERE value < 2) AS r0 FROM events WHERE event_type='purchase' GROUP BY 1)
SELECT e.user_id, coalesce(cohort_rows,0) AS cohort_rows, coalesce(unwanted_rows,0) AS unwanted_rows, coalesce(cohort_rows=12 AND r0=1, false) AS cohort_exact, coalesce(cohort_rows=12 AND r0=1 AND unwanted_rows=0, false) AS holds
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN g USING (user_id)
""")
def negative_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return L.negative_evidence(e, ["user_id"], F.col("event_type") == "purchase", [F.col("value") < 2], F.col("value") > 60, expected_rows=12)


@plan("input_evidence", """
WITH i AS (SELECT p_partkey AS input_id, CAST(p_size AS VARCHAR) AS value_text, p_type AS unit FROM part),
d AS (SELECT l_partkey AS input_id, count(*) AS n, min(CAST(l_linenumber AS VARCHAR)) AS v FROM lineitem WHERE l_quantity >= 49 GROUP BY 1)
SELECT input_id, coalesce(n,0) AS direct_rows, CASE WHEN n=1 AND value_text=v THEN 'direct' WHEN n=1 THEN 'value-mismatch' WHEN n>1 THEN 'ambiguous' WHEN unit='PROMO' THEN 'boundary' ELSE 'none' END AS evidence FROM i LEFT JOIN d USING (input_id)
""")
def input_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part")
    inputs = p.select(F.col("p_partkey").alias("input_id"), F.col("p_size").cast("string").alias("value_text"), F.col("p_type").alias("unit"))
    li = load_table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("input_id"), F.col("l_linenumber").cast("string").alias("value_text"))
    direct = li.join(inputs.select("input_id", "unit"), "input_id")
    boundary = inputs.filter("unit = 'PROMO'")
    return L.input_evidence(inputs, direct, boundary).select("input_id", "direct_rows", "evidence")


@plan("lineage_transforms", """
WITH l AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total, count(*) FILTER (WHERE l_returnflag='R') AS absent FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN CAST(total AS VARCHAR) WHEN '2-HIGH' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN '3-MEDIUM' THEN CAST(total * 4 AS VARCHAR) WHEN '4-NOT SPECIFIED' THEN '5@0.1;above@0.2'
 ELSE CASE WHEN absent=0 THEN 'uncapped' END END AS value FROM orders JOIN l ON o_orderkey=l_orderkey
""")
def lineage_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("absent")
    )
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    pr = F.col("o_orderpriority")
    name = (
        F.when(pr == "1-URGENT", F.lit("sum")).when(pr == "2-HIGH", F.lit("calculator-execution")).when(pr == "3-MEDIUM", F.lit("crs-fixed-profile"))
        .when(pr == "4-NOT SPECIFIED", F.lit("boundary-serialization")).otherwise(F.lit("uncapped-availability"))
    )
    value = L.transform_outcome(
        name, total=F.col("total"), calculated=F.floor("o_totalprice"), points=F.col("total") * 4, serialized=F.lit("5@0.1;above@0.2"),
        absent_rows=F.col("absent"), expected_absent=F.lit(0), constant=F.lit("uncapped"),
    )
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", value.alias("value"))
