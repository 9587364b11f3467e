"""Reconciliation joins, audits and set comparisons over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import arrays, fingerprints, urls, variants
from trustframe.functions.numbers import canonical_decimal
from trustframe.operators import bindings as B
from trustframe.operators import filters, ranking, rules
from trustframe.operators import reconcile as R
from trustframe.operators.entities import exact_duplicates
from trustframe.plans.registry import plan
from trustframe.session import load_table, spread


@plan("parity_groups", """
WITH f AS (SELECT p_name, p_brand, p_type, min(p_partkey) AS k, arg_min(p_size, p_partkey) AS base_p_size, count(*) AS n FROM part GROUP BY 1,2,3)
SELECT p_partkey, p_size, base_p_size FROM part JOIN f USING (p_name, p_brand, p_type) WHERE n > 1 AND p_size <> base_p_size
""")
def parity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    out = ranking.deviating_rows(p, ["p_name", "p_brand", "p_type"], "p_partkey", ["p_size"])
    return out.select("p_partkey", "p_size", "base_p_size")


@plan("parity_with_exemptions", """
WITH c AS (SELECT * FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderpriority <> '1-URGENT'),
f AS (SELECT o_custkey, o_orderdate, arg_min(o_orderstatus, o_orderkey) AS base_o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS base_o_orderpriority, count(*) AS n FROM c GROUP BY 1,2)
SELECT o_orderkey, base_o_orderstatus, base_o_orderpriority FROM c JOIN f USING (o_custkey, o_orderdate) WHERE n>1 AND (o_orderstatus<>base_o_orderstatus OR o_orderpriority<>base_o_orderpriority)
""")
def parity_with_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only official or derived claims without an exemption are comparable."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    comparable = F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") != "1-URGENT")
    out = ranking.deviating_rows(o, ["o_custkey", "o_orderdate"], "o_orderkey", ["o_orderstatus", "o_orderpriority"], comparable)
    return out.select("o_orderkey", "base_o_orderstatus", "base_o_orderpriority")


@plan("group_completeness", """
WITH b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag='R' AND l_quantity > 25),
g AS (SELECT p_name || '/' || p_brand AS grp, count(*) AS members, count(*) FILTER (WHERE l_partkey IS NULL) AS unbound FROM part LEFT JOIN b ON p_partkey=l_partkey GROUP BY 1)
SELECT grp, members, unbound, CASE WHEN members < 2 THEN 'ORPHAN_GROUP' ELSE 'UNBOUND_MEMBER' END AS code FROM g WHERE members < 2 OR unbound > 0
""")
def group_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("grp"), F.col("p_partkey").alias("member"))
    bound = load_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_partkey").alias("member"))
    return R.group_completeness(p, "grp", "member", bound)


@plan("reconcile_full", """
WITH a AS (SELECT o_orderkey AS k, count(*) AS left_rows FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS right_rows FROM lineitem GROUP BY 1),
c AS (SELECT o_custkey AS k, count(*) AS left_rows FROM orders GROUP BY 1), d AS (SELECT c_custkey AS k, count(*) AS right_rows FROM customer GROUP BY 1),
j AS (SELECT 'orders-lineitem' AS pair, k, left_rows, right_rows FROM a FULL JOIN b USING (k) UNION ALL SELECT 'orders-customer', k, left_rows, right_rows FROM c FULL JOIN d USING (k))
SELECT pair, k, CASE WHEN right_rows IS NULL THEN 'ORPHAN' WHEN left_rows IS NULL THEN 'MISSING' WHEN left_rows > 1 THEN 'DUPLICATE' ELSE 'MATCHED' END AS outcome,
 coalesce(left_rows,0) AS left_rows, coalesce(right_rows,0) AS right_rows FROM j
""")
def reconcile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, c = (load_table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    one = R.full_reconcile(o.select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k")), ["k"])
    two = R.full_reconcile(o.select(F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k")), ["k"])
    return one.select(F.lit("orders-lineitem").alias("pair"), "*").unionByName(two.select(F.lit("orders-customer").alias("pair"), "*"))


@plan("field_mismatches", """
WITH l AS (SELECT l_orderkey AS k, CASE WHEN bool_and(l_linestatus='F') THEN 'F' WHEN bool_and(l_linestatus='O') THEN 'O' ELSE 'P' END AS status, count(*) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(4 AS BIGINT) AS lines FROM orders)
SELECT o.k, 'status' AS field, o.status AS left_value, l.status AS right_value FROM o JOIN l USING (k) WHERE o.status <> l.status
UNION ALL SELECT o.k, 'lines', CAST(o.lines AS VARCHAR), CAST(l.lines AS VARCHAR) FROM o JOIN l USING (k) WHERE o.lines <> l.lines
""")
def field_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.when(F.bool_and(F.col("l_linestatus") == "F"), F.lit("F")).when(F.bool_and(F.col("l_linestatus") == "O"), F.lit("O")).otherwise(F.lit("P")).alias("status"),
        F.count(F.lit(1)).alias("lines"),
    )
    o = load_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.lit(4).cast("bigint").alias("lines"))
    return R.mismatches(o, li, ["k"], ["status", "lines"])


@plan("exactly_one", """
SELECT o_orderkey AS k, count(l_orderkey) AS matches FROM orders LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_linenumber=1) ON o_orderkey=l_orderkey GROUP BY 1 HAVING count(l_orderkey)<>1
""")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    first = load_table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return R.not_exactly_one(o, first, ["k"])


@plan("unmatched_rows", """
SELECT 'customer without order' AS what, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'part neither ordered nor promoted', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_type <> 'PROMO'
UNION ALL SELECT 'order of unknown customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
""")
def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, p, li = (load_table(spark, sf_dir, t) for t in ("customer", "orders", "part", "lineitem"))
    idle = R.unmatched(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), ["k"])
    loose = R.unreferenced(
        p.select(F.col("p_partkey").alias("k")),
        [li.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")), p.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("k"))], "k",
    )
    known = c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("ck"))
    lost = R.unmatched(o.select("o_orderkey", F.col("o_custkey").alias("ck")), known, ["ck"]).select(F.col("o_orderkey").alias("k"))
    return (
        idle.select(F.lit("customer without order").alias("what"), "k")
        .unionByName(loose.select(F.lit("part neither ordered nor promoted").alias("what"), "k"))
        .unionByName(lost.select(F.lit("order of unknown customer").alias("what"), "k"))
    )


@plan("multiset_difference", """
WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus='O' GROUP BY 1,2), b AS (SELECT l_orderkey, l_returnflag, count(*) AS m FROM lineitem WHERE l_quantity<=25 GROUP BY 1,2)
SELECT l_orderkey, l_returnflag, CASE WHEN coalesce(n,0) > coalesce(m,0) THEN 'left' ELSE 'right' END AS side, CAST(abs(coalesce(n,0)-coalesce(m,0)) AS BIGINT) AS copies FROM a FULL JOIN b USING (l_orderkey, l_returnflag) WHERE coalesce(n,0)<>coalesce(m,0)
""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem")
    return R.set_difference(li.filter("l_linestatus = 'O'"), li.filter("l_quantity <= 25"), ["l_orderkey", "l_returnflag"])


@plan("edition_owner", """
SELECT c_custkey, n_regionkey AS edition_region, c_custkey % 5 AS declared_region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_name<>'NATION_7') n ON c_nationkey=n_nationkey WHERE n_regionkey IS NULL OR n_regionkey <> c_custkey % 5
""")
def edition_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("edition"), (F.col("c_custkey") % 5).alias("region"))
    editions = load_table(spark, sf_dir, "nation").filter("n_name <> 'NATION_7'").select(F.col("n_nationkey").alias("edition"), F.col("n_regionkey").cast("bigint").alias("region"))
    out = R.owner_mismatches(c, editions, "edition", ["region"])
    return out.select("c_custkey", F.col("__o_region").cast("int").alias("edition_region"), F.col("region").alias("declared_region"))


@plan("effective_cover", """
WITH e AS (SELECT CAST(l_shipdate AS DATE) AS v, CAST(o_orderdate AS DATE) AS od, l_returnflag AS rf, l_linestatus AS ls FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
r AS (SELECT *, v - 60 AS f, CASE WHEN rf='R' THEN v - 50 END AS t, CASE WHEN ls='O' THEN v + 1 END AS c FROM e)
SELECT code, rf, ls, count(*) AS n FROM (
 SELECT 'PREDATES_OUTPUT' AS code, rf, ls FROM r WHERE v < od UNION ALL SELECT 'FUTURE', rf, ls FROM r WHERE v > DATE '2001-06-01'
 UNION ALL SELECT 'STALE', rf, ls FROM r WHERE date_diff('day', v, DATE '2001-06-01') > 1000 UNION ALL SELECT 'CURRENT_AFTER_VERIFIED', rf, ls FROM r WHERE c > v
 UNION ALL SELECT 'STARTS_AFTER_OUTPUT', rf, ls FROM r WHERE f > od UNION ALL SELECT 'ENDS_BEFORE_OUTPUT', rf, ls FROM r WHERE t < od) GROUP BY 1,2,3
""")
def effective_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"))
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    v, od = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    codes = R.evidence_window_problems(
        v, F.date_sub(v, 60), F.when(F.col("rf") == "R", F.date_sub(v, 50)), F.when(F.col("ls") == "O", F.date_add(v, 1)),
        F.lit(1000), od, od, F.lit("2001-06-01").cast("date"),
    )
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("rf", "ls", F.explode(codes).alias("code"))
    return rows.groupBy("code", "rf", "ls").agg(F.count(F.lit(1)).alias("n"))


@plan("json_leaves", """
WITH e AS (SELECT event_id, event_type, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)
SELECT event_id, '/t' AS pointer, 'string' AS leaf_type, event_type AS leaf_value FROM e
UNION ALL SELECT event_id, '/p/k', 'number', CAST(k AS VARCHAR) FROM e
UNION ALL SELECT event_id, '/v/0', 'number', CAST(event_id AS VARCHAR) FROM e
UNION ALL SELECT event_id, '/v/1', 'null', NULL FROM e
UNION ALL SELECT event_id, '/e', 'array', '[]' FROM e
UNION ALL SELECT event_id, '/d' || repeat('/0', 19), 'boolean', 'true' FROM e
""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    doc = F.concat(F.lit('{"t":"'), "event_type", F.lit('","p":'), "props", F.lit(',"v":['), F.col("event_id").cast("string"), F.lit(',null],"e":[],"d":' + "[" * 19 + "true" + "]" * 19 + "}"))
    docs = e.select("event_id", F.try_parse_json(doc).alias("doc"))
    return variants.explode_leaves(docs, "doc", ["event_id"])


@plan("key_contract", """
SELECT event_id, event_type='click' AS bad_two_keys, event_type='error' AS bad_optional, event_type IN ('view','error') AS blank_text, event_type='signup' AS not_scalar FROM events
""")
def key_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    t = F.col("event_type")
    inner = F.when(t == "signup", F.lit("[1]")).when(t == "view", F.lit('" "')).when(t == "error", F.lit("null")).otherwise(F.lit('"ok"'))
    doc = F.concat(F.lit('{"k":1'), F.when(t == "click", F.lit("")).otherwise(F.lit(',"v":2')), F.when(t == "error", F.lit(',"zz":3')).otherwise(F.lit("")), F.lit(',"s":'), inner, F.lit("}"))
    docs = e.select("event_id", doc.alias("doc"), F.try_parse_json(doc).alias("v"))
    s = F.try_variant_get("v", "$.s", "variant")
    return docs.select(
        "event_id", (F.size(rules.missing_keys(F.col("doc"), ["k", "v"])) > 0).alias("bad_two_keys"),
        (rules.keys_not_exact(F.col("doc"), ["k"], ["v", "s"])).alias("bad_optional"),
        (rules.not_text(s) & ~rules.not_finite_scalar(s) | (variants.json_type(s) == "null")).alias("blank_text"),
        (rules.not_finite_scalar(s) & (variants.json_type(s) != "null")).alias("not_scalar"),
    )


@plan("value_transforms", """
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN CAST(k AS VARCHAR) WHEN 'click' THEN CAST(k * 100 AS VARCHAR) WHEN 'signup' THEN CAST(k + user_id AS VARCHAR)
 WHEN 'error' THEN k || '-' || user_id ELSE k || '-' || (k + user_id) END AS value,
 CASE event_type WHEN 'error' THEN k || ',' || user_id WHEN 'purchase' THEN k || ',' || (k + user_id) WHEN 'view' THEN CAST(k AS VARCHAR) WHEN 'click' THEN CAST(k * 100 AS VARCHAR) ELSE CAST(k + user_id AS VARCHAR) END AS bounds FROM e
""")
def value_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    rows = e.select("event_id", "event_type", "user_id", k.alias("k"))
    t = F.col("event_type")
    op = F.when(t == "view", F.lit("identity")).when(t == "click", F.lit("multiply")).when(t == "signup", F.lit("sum")).when(t == "error", F.lit("joinRange")).otherwise(F.lit("extractRange"))
    nums = F.array("k", "user_id").cast("array<decimal(38,18)>")
    text = F.when(t == "purchase", F.concat(F.lit("about "), F.col("k").cast("string"), F.lit(" ~ "), (F.col("k") + F.col("user_id")).cast("string"), F.lit(" units")))
    value = arrays.transform_value(op, nums, text, F.lit(100).cast("decimal(38,18)"))
    staged = rows.select("event_id", value.alias("value"))
    return staged.select("event_id", "value", F.array_join(arrays.boundary_values(F.col("value")), ",").alias("bounds"))


@plan("json_records", """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type FROM events)
SELECT event_id, CASE WHEN event_type IN ('click','view') THEN 1 WHEN event_type='error' THEN 2 ELSE 0 END AS matches, CASE WHEN event_type IN ('click','view') THEN CAST(user_id AS VARCHAR) END AS value, event_type='purchase' AS exact_pair FROM e
""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trustframe.sources.readers import json_pointer_record, json_record

    e = load_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    hit = F.concat(F.lit('{"code":"801","kind":"base","fee":{"value":'), u, F.lit("}}"))
    miss = F.lit('{"code":"820","kind":"base","fee":{"value":1}}')
    arr = F.when(t.isin("click", "view"), F.concat_ws(",", miss, hit)).when(t == "error", F.concat_ws(",", hit, hit)).otherwise(miss)
    unit = F.when(t == "purchase", F.lit('{"unit":"AUD","value":5}')).otherwise(F.lit('{"unit":"AUD","value":5,"x":1}'))
    doc = F.concat(F.lit('{"d":{"data":['), arr, F.lit("]},\"r\":"), unit, F.lit("}"))
    docs = e.select("event_id", doc.alias("doc"))
    found = json_record(docs, ["event_id"], "doc", "/d/data", {"code": "801", "kind": "base"}, "/fee/value")
    pairs = docs.select("event_id", json_pointer_record(F.col("doc"), "/r").isNotNull().alias("exact_pair"))
    return found.join(pairs, "event_id").select("event_id", F.col("matches").cast("int").alias("matches"), "value", "exact_pair")


LEAF_SQL = r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url,'^[a-z]+://([^/?#]*)',1)) AS host, rtrim(regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1),'/') AS path FROM pages),
leaf AS (SELECT DISTINCT host, path FROM u WHERE path<>''),
m AS (SELECT host, regexp_extract(path,'^(/[^/]*)',1) AS p, 'lang' AS owner FROM leaf WHERE path NOT LIKE '/fr/%' UNION SELECT host, '/', 'site' FROM leaf WHERE host LIKE '%.org' UNION SELECT host, path, 'page' FROM leaf WHERE path LIKE '%.html')
"""


def leaf_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = load_table(spark, sf_dir, "pages").select("url")
    leaf = p.select(urls.host(F.col("url")).alias("host"), F.rtrim(urls.path(F.col("url")), F.lit("/")).alias("path")).filter("path <> ''").distinct()
    lang = leaf.filter(~F.col("path").like("/fr/%")).select("host", F.regexp_extract("path", "^(/[^/]*)", 1).alias("p"), F.lit("lang").alias("owner"))
    site = leaf.filter(F.col("host").like("%.org")).select("host", F.lit("/").alias("p"), F.lit("site").alias("owner"))
    page = leaf.filter(F.col("path").like("%.html")).select("host", F.col("path").alias("p"), F.lit("page").alias("owner"))
    return leaf, lang.unionByName(site).unionByName(page).distinct()


@plan("leaf_owners", LEAF_SQL + """
SELECT leaf.host, path, count(p) AS owners FROM leaf LEFT JOIN m ON leaf.host=m.host AND (p='/' OR path=p OR path LIKE p || '/%') GROUP BY 1,2
""")
def leaf_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf, mappings = leaf_tables(spark, sf_dir)
    return R.leaf_owners(leaf, mappings, "host", "path", "p")


@plan("component_owners", LEAF_SQL + """
SELECT leaf.host, path, count(p) AS owners FROM leaf LEFT JOIN m ON leaf.host=m.host AND (p='/' OR path=p OR path LIKE p || '/%') GROUP BY 1,2 HAVING count(p)<>1
""")
def component_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf, mappings = leaf_tables(spark, sf_dir)
    return R.component_owners(leaf.withColumnRenamed("path", "leaf"), mappings, "host", "leaf", "p", "owner").withColumnRenamed("leaf", "path")


@plan("mapping_overlaps", LEAF_SQL + """
SELECT a.host, a.p, a.owner, min(b.owner) AS other_owner, min(b.p) AS covering_path FROM m a JOIN m b ON a.host=b.host AND a.owner<>b.owner AND (b.p='/' OR a.p=b.p OR a.p LIKE b.p || '/%') GROUP BY 1,2,3
""")
def mapping_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mappings = leaf_tables(spark, sf_dir)
    return R.mapping_overlaps(mappings, "host", "p", "owner")


@plan("allowed_hosts", r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url,'^[a-z]+://([^/?#]*)',1)) AS host, regexp_extract(url,'^[a-z]+://[^/]*/([a-z]+)/',1) AS lang FROM pages)
SELECT page_id, host, lang FROM u WHERE (lang='en' AND (host LIKE '%.example.com')) OR (lang='fr' AND host LIKE '%.example.net')
""")
def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "pages").select(
        "page_id", urls.host(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1).alias("lang")
    )
    allow = spark.createDataFrame([("en", "example.com"), ("fr", "example.net")], "lang string, domain string")
    return R.allowed_hosts(p, "host", allow, "lang")


@plan("range_lookup", """
WITH r AS (SELECT p_partkey, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS lo, CAST(floor(p_retailprice) + p_size AS BIGINT) AS hi FROM part)
SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, 'Brand#' || (1 + s_nationkey) AS brand, CAST(900 + abs(floor(s_acctbal)) % 200 AS BIGINT) AS v FROM supplier) s JOIN r ON brand=p_brand AND v BETWEEN lo AND hi
""")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.floor("p_retailprice").alias("lo"), (F.floor("p_retailprice") + F.col("p_size")).alias("hi")
    )
    s = load_table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("brand"), (F.abs(F.floor("s_acctbal")) % 200 + 900).alias("v")
    )
    return R.range_join(s, r, ["brand"], "v", "lo", "hi", 25).select("s_suppkey", "p_partkey")


@plan("status_summary", """
SELECT c_mktsegment, s.status, count(*) FILTER (WHERE CASE WHEN c_acctbal < 0 THEN 'changed' WHEN c_acctbal < 3000 THEN 'match' ELSE 'blocked' END = s.status) AS n
FROM customer, (VALUES ('match'),('changed'),('blocked'),('transient'),('unsupported')) s(status) GROUP BY 1,2
""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer").select(
        "c_mktsegment", F.when(F.col("c_acctbal") < 0, F.lit("changed")).when(F.col("c_acctbal") < 3000, F.lit("match")).otherwise(F.lit("blocked")).alias("status")
    )
    return R.status_summary(c, "status", ["match", "changed", "blocked", "transient", "unsupported"], ["c_mktsegment"])


@plan("caps", """
SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 16
""")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.over_cap(load_table(spark, sf_dir, "orders"), ["o_custkey"], 16)


@plan("report_fingerprint", """
WITH r AS (SELECT c_mktsegment, sha256('=' || c_custkey || chr(31) || '=' || c_name || chr(31) || '=' || c_nationkey) AS d FROM customer),
l AS (SELECT c_mktsegment, count(*) AS row_count, sum(('0x' || substr(d,1,15))::UBIGINT) AS a, sum(('0x' || substr(d,16,15))::UBIGINT) AS b, sum(('0x' || substr(d,31,15))::UBIGINT) AS c, sum(('0x' || substr(d,46,15))::UBIGINT) AS e FROM r GROUP BY 1)
SELECT c_mktsegment, row_count, sha256(row_count || ':' || a || ':' || b || ':' || c || ':' || e) AS fingerprint FROM l
""")
def report_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    return fingerprints.report_fingerprint(c, ["c_custkey", "c_name", "c_nationkey"], ["c_mktsegment"])


BIND_SQL = """
WITH b AS (SELECT o_orderkey AS ord, o_custkey AS cust, CASE WHEN o_orderpriority='1-URGENT' THEN -o_orderkey - 1 ELSE o_orderkey END AS claim, o_orderstatus AS ed,
  CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderpriority AS pr, strftime(o_orderdate,'%Y-%m-%d') AS d FROM orders),
c AS (SELECT o_orderkey AS claim, CASE WHEN o_orderstatus='F' THEN 'NZ' ELSE 'CA' END AS country, CASE WHEN o_orderpriority='2-HIGH' THEN 'CAD' ELSE 'NZD' END AS unit,
  CASE WHEN o_orderpriority='3-MEDIUM' THEN CAST(floor(o_totalprice) AS BIGINT) + 1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS cv, o_orderstatus AS st FROM orders),
j AS (SELECT b.*, c.claim IS NOT NULL AS has, country, unit, cv FROM b LEFT JOIN c ON b.claim=c.claim)
"""


@plan("bindings_check", BIND_SQL + """
SELECT code, count(*) AS n FROM (
 SELECT 'ORPHAN_BINDING' AS code FROM j WHERE NOT has
 UNION ALL SELECT 'EDITION_UNKNOWN' FROM j WHERE ed='P'
 UNION ALL SELECT 'EDITION_OWNER' FROM j WHERE has AND ed<>'P' AND NOT ((ed='F' AND country='NZ') OR (ed='O' AND country='CA' AND pr<>'5-LOW'))
 UNION ALL SELECT 'EDITION_PAGE' FROM j WHERE ed='O' AND pr='5-LOW'
 UNION ALL SELECT 'UNIT_MISMATCH' FROM j WHERE has AND unit<>'NZD'
 UNION ALL SELECT 'VALUE_MISMATCH' FROM j WHERE has AND v<>cv
 UNION ALL SELECT 'PROVENANCE_URL' FROM j WHERE has AND pr='4-NOT SPECIFIED'
 UNION ALL SELECT 'UNBOUND_CLAIM' FROM orders WHERE o_orderpriority='1-URGENT'
 UNION ALL SELECT 'UNSCOPED_BINDING' FROM j WHERE NOT has) GROUP BY 1
""")
def bindings_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"), "o_orderkey")
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    whole = F.floor("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    b = o.select(
        F.col("o_orderkey").alias("ord"), F.when(pr == "1-URGENT", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("claim_id"),
        st.alias("edition"), F.when((st == "O") & (pr == "5-LOW"), F.lit("other.html")).otherwise(F.concat(st, F.lit(".html"))).alias("page"),
        F.col("o_orderkey").cast("string").alias("runtime_path"), F.lit("number").alias("type"), F.lit("NZD").alias("unit"),
        F.when(st == "F", F.lit("sum")).otherwise(F.lit("identity")).alias("op"),
        F.when(st == "F", F.array(whole - 7, F.lit(7))).otherwise(F.array(whole)).cast("array<decimal(38,18)>").alias("numbers"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("decimal(38,18)").alias("factor"),
        F.concat(F.lit("HTTPS://Stats.example.org:443/"), F.when(pr == "4-NOT SPECIFIED", F.lit("old")).otherwise(F.lit("now"))).alias("runtime_url"),
        day.alias("runtime_date"),
    )
    c = o.select(
        F.col("o_orderkey").alias("claim_id"), F.when(st == "F", F.lit("NZ")).otherwise(F.lit("CA")).alias("country"), F.lit("ko").alias("locale"),
        F.array(F.concat(st, F.lit(".html"))).alias("pages"), F.when(pr == "2-HIGH", F.lit("CAD")).otherwise(F.lit("NZD")).alias("unit"), F.lit("number").alias("value_type"),
        canonical_decimal(F.when(pr == "3-MEDIUM", whole + 1).otherwise(whole)).alias("value_text"), F.lit("https://stats.example.org/now").alias("source_url"), day.alias("verified_at"),
    )
    editions = spark.createDataFrame([("F", "F.html", "NZ", "ko"), ("O", "O.html", "CA", "ko")], "edition string, page string, country string, locale string")
    issues = B.binding_issues(b, c, editions, c.select("claim_id"))
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@plan("asset_contract", """
WITH d AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT c_nationkey, c_mktsegment || '-' || (c_custkey // 2) AS id, min(c_custkey) AS k, count(*) AS n FROM customer GROUP BY 1,2)
SELECT 'COUNT' AS code, CAST(c_nationkey AS VARCHAR) AS entity_id FROM d WHERE n % 3 <> 0
UNION ALL SELECT 'DUPLICATE_ID', c_mktsegment || '-' || (c_custkey // 2) FROM customer JOIN f ON customer.c_nationkey=f.c_nationkey AND c_mktsegment || '-' || (c_custkey // 2)=f.id WHERE c_custkey<>k
UNION ALL SELECT 'VACANCY', c_mktsegment || '-' || (c_custkey // 2) FROM customer WHERE c_acctbal < 0
""")
def asset_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    asset = c.select(
        F.col("c_custkey").alias("ord"), F.col("c_nationkey").cast("string").alias("country"),
        F.concat_ws("-", "c_mktsegment", F.floor(F.col("c_custkey") / 2).cast("string")).alias("id"),
        F.when(F.col("c_acctbal") < 0, F.lit("hiring")).otherwise(F.lit("directory-only")).alias("vacancy_status"),
    )
    meta = asset.groupBy("country").agg(F.count(F.lit(1)).alias("n")).select("country", (F.floor(F.col("n") / 3) * 3).alias("count"))
    return filters.asset_problems(asset, meta).select("code", "entity_id")


@plan("exact_duplicates", """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1,2 HAVING count(*)>1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, copies FROM lineitem JOIN g USING (l_orderkey, l_linenumber)
""")
def exact_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return exact_duplicates(li, ["l_orderkey", "l_linenumber"])
