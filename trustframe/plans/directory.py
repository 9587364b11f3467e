"""Directory checks: filters, audits, geography, duplicates, matching, normalisation, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import fingerprints, text
from trustframe.operators import entities as E
from trustframe.operators import filters, rules
from trustframe.operators import reconcile as R
from trustframe.plans.registry import plan
from trustframe.session import load_table, spread
from trustframe.sources.readers import unnest_field_list, url_roles, url_summary

DIRECTORY_SQL = """
WITH d AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS label, n_name AS region, [c_mktsegment, 'zone' || c_nationkey] AS work_types,
  CASE WHEN c_acctbal < 0 THEN 'unverified' WHEN c_nationkey < 10 THEN 'government-register' ELSE 'employer-official' END AS source_kind,
  CASE WHEN c_nationkey < 5 THEN 'region' ELSE 'town' END AS precision, CASE WHEN c_acctbal < 0 THEN 'uncertain' WHEN c_acctbal > 8000 THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN c_nationkey < 12 THEN 'NZ' ELSE 'AU' END AS country, CASE WHEN c_acctbal < 2000 THEN 'none' ELSE 'company' END AS contact_kind,
  'https://s' || c_nationkey || '.co.nz/' AS source_url, CASE WHEN c_acctbal >= 2000 THEN 'https://c' || (c_custkey // 4) || '.co.nz/' END AS contact_url
  FROM customer JOIN nation ON c_nationkey=n_nationkey)
"""


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    n = load_table(spark, sf_dir, "nation")
    bal, nat = F.col("c_acctbal"), F.col("c_nationkey")
    return c.join(n, nat == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), F.col("n_name").alias("region"),
        F.array(F.col("c_mktsegment"), F.concat(F.lit("zone"), nat.cast("string"))).alias("work_types"),
        F.when(bal < 0, F.lit("unverified")).when(nat < 10, F.lit("government-register")).otherwise(F.lit("employer-official")).alias("source_kind"),
        F.when(nat < 5, F.lit("region")).otherwise(F.lit("town")).alias("precision"),
        F.when(bal < 0, F.lit("uncertain")).when(bal > 8000, F.lit("expired")).otherwise(F.lit("active")).alias("status"),
        F.when(nat < 12, F.lit("NZ")).otherwise(F.lit("AU")).alias("country"),
        F.when(bal < 2000, F.lit("none")).otherwise(F.lit("company")).alias("contact_kind"),
        F.concat(F.lit("https://s"), nat.cast("string"), F.lit(".co.nz/")).alias("source_url"),
        F.when(bal >= 2000, F.concat(F.lit("https://c"), F.floor(F.col("c_custkey") / 4).cast("string"), F.lit(".co.nz/"))).alias("contact_url"),
    )


@plan("directory_filter", DIRECTORY_SQL + """
SELECT id, name FROM d WHERE status='active' AND source_kind='employer-official' AND precision='town' AND list_contains(work_types,'BUILDING') AND contains(lower(name || ' ' || label || ' ' || region || ' ' || array_to_string(work_types,' ')), 'nation_1')
""")
def directory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = directory(spark, sf_dir)
    out = filters.directory_filter(d, q=" NATION_1", work_type="BUILDING", source="employer-official", precision="town", status="active")
    return out.select("id", "name")


@plan("season_filter", """
SELECT s_suppkey FROM supplier WHERE s_nationkey % 12 + 1 = 4 OR s_suppkey % 12 + 1 = 4
""")
def season_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_table(spark, sf_dir, "supplier")
    months = F.array((F.col("s_nationkey") % 12 + 1).cast("int"), (F.col("s_suppkey") % 12 + 1).cast("int"))
    return filters.season_filter(s.withColumn("months", months), 4).select("s_suppkey")


@plan("directory_audit", DIRECTORY_SQL + """
SELECT 'rows' AS metric, '' AS value, count(*) AS n FROM d UNION ALL SELECT 'contactable', '', count(*) FROM d WHERE contact_kind<>'none'
UNION ALL SELECT 'country', country, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM d GROUP BY 2
""")
def directory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.directory_audit(directory(spark, sf_dir))


@plan("locator_count", DIRECTORY_SQL + """
SELECT count(DISTINCT u) AS locators FROM (SELECT source_url AS u FROM d UNION ALL SELECT contact_url FROM d WHERE contact_url IS NOT NULL)
""")
def locator_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.locator_count(directory(spark, sf_dir))


@plan("url_owner_roles", DIRECTORY_SQL + """,
r AS (SELECT source_url AS url, id, 'source' AS role FROM d UNION ALL SELECT contact_url, id, 'contact' FROM d WHERE contact_url IS NOT NULL)
SELECT url, count(DISTINCT id) AS owners, min(id) AS first_owner, bool_or(role='source') AS is_source, bool_or(role='contact') AS is_contact FROM r GROUP BY 1
""")
def url_owner_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_summary(url_roles(directory(spark, sf_dir), "id", "source_url", "contact_url"))


@plan("audit_differences", DIRECTORY_SQL + """,
c AS (SELECT status AS metric, count(*) AS computed FROM d GROUP BY 1), x AS (SELECT o_orderstatus AS metric, count(*) AS declared FROM orders GROUP BY 1 UNION ALL SELECT 'active', count(*) FROM d WHERE status='active')
SELECT metric, declared, computed FROM x FULL JOIN c USING (metric) WHERE declared IS DISTINCT FROM computed
""")
def audit_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = directory(spark, sf_dir)
    computed = d.groupBy(F.col("status").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    declared = load_table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    declared = declared.unionByName(d.filter("status = 'active'").groupBy(F.lit("active").alias("metric")).agg(F.count(F.lit(1)).alias("n")))
    return R.audit_differences(declared, computed)


CENTRES_SQL = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}', {a}::DOUBLE, {b}::DOUBLE)" for i, (n, a, b) in enumerate(P.REGION_CENTRES))


def _hav(a, b, c, d):
    return (
        f"2 * 6371000.0 * asin(sqrt(least(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
        f"power(sin(radians({d} - {b}) / 2), 2), 1.0)))"
    )


@plan("nearest_region", f"""
WITH s AS (SELECT s_suppkey, -47.0 + (s_suppkey * 37 % 1300) / 100.0 AS lat, 166.0 + (s_suppkey * 91 % 1300) / 100.0 AS lng FROM supplier),
r(i, name, rlat, rlng) AS (VALUES {CENTRES_SQL})
SELECT s_suppkey, arg_min(name, {_hav('lat', 'lng', 'rlat', 'rlng')}) AS region FROM s, r GROUP BY 1
""")
def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_table(spark, sf_dir, "supplier")
    lat = F.lit(-47.0) + (F.col("s_suppkey") * 37 % 1300) / 100.0
    lng = F.lit(166.0) + (F.col("s_suppkey") * 91 % 1300) / 100.0
    return s.select("s_suppkey", E.nearest_centre(lat, lng).alias("region"))


NEAR_SQL = f"""
WITH e AS (SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || c_nationkey AS name_key, CASE WHEN c_acctbal < 3000 THEN '' ELSE 'https://c' || (c_custkey % 7) || '.nz/' END AS contact_key,
  -36.8 + (c_custkey * 7919 % 40) * 0.0005 AS lat, 174.7 + (c_custkey * 104729 % 30) * 0.0005 AS lng FROM customer),
s AS (SELECT name_key, contact_key, lat, lng, min(id) AS site, count(*) AS n FROM e GROUP BY 1,2,3,4),
p AS (SELECT a.site AS first_id, b.site AS second_id, {_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS d, a.name_key=b.name_key AS sn, a.contact_key<>'' AND a.contact_key=b.contact_key AS sc, a.n AS first_rows, b.n AS second_rows
  FROM s a JOIN s b ON a.site < b.site AND (a.name_key=b.name_key OR (a.contact_key<>'' AND a.contact_key=b.contact_key)))
"""


def near_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.concat_ws(" ", text.norm_name(F.col("c_mktsegment")), F.col("c_nationkey").cast("string")).alias("name_key"),
        F.when(F.col("c_acctbal") < 3000, F.lit("")).otherwise(F.concat(F.lit("https://c"), (k % 7).cast("string"), F.lit(".nz/"))).alias("contact_key"),
        (F.lit(-36.8) + (k * 7919 % 40) * 0.0005).alias("lat"), (F.lit(174.7) + (k * 104729 % 30) * 0.0005).alias("lng"),
    )


@plan("near_duplicates", NEAR_SQL + """
SELECT first_id, second_id, CAST(floor(round(d, 1) + 0.5) AS BIGINT) AS metres, CASE WHEN sn AND sc THEN 'same-name-and-contact' WHEN sn THEN 'same-name' ELSE 'same-contact' END AS reason, first_rows, second_rows FROM p WHERE d <= 200
UNION ALL SELECT site, id, 0, CASE WHEN e.contact_key<>'' THEN 'same-name-and-contact' ELSE 'same-name' END, 1, 1 FROM e JOIN s USING (name_key, contact_key, lat, lng) WHERE id<>site
""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.near_duplicates(near_entities(spark, sf_dir), 200.0)
    return out.withColumn("metres", F.floor(F.col("distance_m") + 0.5)).drop("distance_m")


@plan("near_duplicate_count", NEAR_SQL + """
SELECT CAST((SELECT sum(n * (n - 1) // 2) FROM s) + (SELECT coalesce(sum(first_rows * second_rows), 0) FROM p WHERE d <= 200) AS BIGINT) AS pairs
""")
def near_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.near_duplicate_count(near_entities(spark, sf_dir), 200.0)


_SIDE = 200.0 * 0.999 / 3**0.5 / 4**12
_CELL_SQL = ", ".join(f"floor(floor({axis} * 6371000.0 / {_SIDE!r}) / {4**12}.0) AS c{i}" for i, axis in enumerate(
    ("cos(radians(lat)) * cos(radians(lng))", "cos(radians(lat)) * sin(radians(lng))", "sin(radians(lat))")))


@plan("near_duplicate_cells", NEAR_SQL + f"""
, k AS (SELECT 'name' AS kind, name_key AS name, '' AS contact, id, lat, lng FROM e UNION ALL SELECT 'contact', '', contact_key, id, lat, lng FROM e WHERE contact_key <> ''),
pt AS (SELECT kind, name, contact, lat, lng, min(id) AS id, count(*) AS n, {_CELL_SQL} FROM k GROUP BY 1,2,3,4,5),
c AS (SELECT *, min(id) OVER (PARTITION BY kind, name, contact, c0, c1, c2) AS f FROM pt)
SELECT kind, name, contact, f AS first_id, NULL AS second_id, CAST(sum(n) * (sum(n) - 1) // 2 AS BIGINT) AS pairs FROM c GROUP BY 1,2,3,4 HAVING sum(n) > 1
UNION ALL SELECT a.kind, a.name, a.contact, a.f, b.f, CAST(sum(a.n * b.n) AS BIGINT) FROM c a JOIN c b USING (kind, name, contact)
 WHERE (a.c0, a.c1, a.c2) < (b.c0, b.c1, b.c2) AND {_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 200 GROUP BY 1,2,3,4,5
""")
def near_duplicate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.near_duplicate_cells(near_entities(spark, sf_dir), 200.0)
    return out.withColumn("pairs", F.col("pairs").cast("bigint"))


@plan("repeated_names", "SELECT p_name || ' ' || p_brand AS name, count(*) AS branches FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select(text.norm_name(F.concat_ws(" ", "p_name", "p_brand")).alias("key"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return E.repeated_names(p, "name")


@plan("one_to_one_match", """
WITH RECURSIVE s AS (SELECT s_suppkey AS k, 'nation ' || s_nationkey AS name, -36.8 + (s_suppkey * 7919 % 1000) * 0.001 AS lat, 174.7 + (s_suppkey * 104729 % 1000) * 0.001 AS lng, s_acctbal FROM supplier),
l AS (SELECT row_number() OVER (ORDER BY k) AS i, * FROM s), r AS (SELECT k, name, lat + CASE WHEN s_acctbal < 0 THEN 0.01 ELSE 0.0 END AS lat, lng FROM s WHERE s_acctbal < 9500),
o AS (SELECT l.i, list(r.k ORDER BY sqrt((l.lat - r.lat) ** 2 + (l.lng - r.lng) ** 2), r.k) AS wishes FROM l JOIN r ON l.name = r.name GROUP BY 1),
step(i, used, best) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL SELECT l.i, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, b
  FROM (SELECT step.i + 1 AS i, step.used, list_filter(coalesce(wishes, []), lambda x: NOT list_contains(step.used, x))[1] AS b FROM step LEFT JOIN o ON o.i = step.i + 1) n JOIN l ON l.i = n.i)
SELECT CASE WHEN best IS NULL THEN 'no record' ELSE 'match' END AS outcome, l.k AS left_id, best AS right_id FROM step JOIN l ON l.i = step.i
UNION ALL SELECT 'orphan record', NULL, k FROM r WHERE k NOT IN (SELECT best FROM step WHERE best IS NOT NULL)
""")
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers against a shifted copy of the same table; names repeat, so nearest points decide."""
    c = load_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.concat_ws(" ", F.lit("nation"), F.col("s_nationkey").cast("string"))
    lat, lng = F.lit(-36.8) + (k * 7919 % 1000) * 0.001, F.lit(174.7) + (k * 104729 % 1000) * 0.001
    shift = F.when(F.col("s_acctbal") < 0, F.lit(0.01)).otherwise(F.lit(0.0))
    left = c.select(k.alias("id"), k.alias("ord"), name.alias("name_key"), lat.alias("lat"), lng.alias("lng"))
    right = c.filter("s_acctbal < 9500").select(k.alias("id"), k.alias("ord"), name.alias("name_key"), (lat + shift).alias("lat"), lng.alias("lng"))
    matches, lost_left, lost_right = E.match_one_to_one(left, right)
    none = F.lit(None).cast("bigint")
    return (
        matches.select(F.lit("match").alias("outcome"), "left_id", "right_id")
        .unionByName(lost_left.select(F.lit("no record").alias("outcome"), F.col("id").alias("left_id"), none.alias("right_id")))
        .unionByName(lost_right.select(F.lit("orphan record").alias("outcome"), none.alias("left_id"), F.col("id").alias("right_id")))
    )


@plan("match_parity", """
WITH s AS (SELECT s_suppkey, s_acctbal, DATE '2026-01-01' + CAST(s_suppkey * 3 AS INTEGER) AS t FROM supplier)
SELECT s_suppkey, 'ADDRESS' AS code FROM s WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'LAT' FROM s WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'EXPIRY' FROM s WHERE s_acctbal > 9000
UNION ALL SELECT s_suppkey, 'STATUS' FROM s WHERE (CASE WHEN s_acctbal > 9000 THEN t + 1 ELSE t END < DATE '2026-07-19')
""")
def match_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_table(spark, sf_dir, "supplier")
    as_of = F.lit("2026-07-19").cast("date")
    end = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("s_suppkey") * 3).cast("int"))
    rows = s.select(
        "s_suppkey", F.col("s_name").alias("name"), F.upper("s_name").alias("r_name"), F.lit("1  Main Road").alias("address"),
        F.when(F.col("s_acctbal") < 0, F.lit("2 Main Road")).otherwise(F.lit("1 Main Road ")).alias("r_address"),
        F.lit(-36.5).alias("lat"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(-36.50002)).otherwise(F.lit(-36.500005)).alias("r_lat"),
        F.lit(174.0).alias("lng"), F.lit(174.0).alias("r_lng"), end.alias("effective_to"),
        F.when(F.col("s_acctbal") > 9000, F.date_add(end, 1)).otherwise(end).alias("r_effective_to"), as_of.alias("checked_at"), F.lit("active").alias("status"),
    )
    return rows.select("s_suppkey", F.explode(E.match_parity_breaks(rows, as_of)).alias("code"))


STATES = list(P.POSTCODE_RANGES)
STATE_SQL = "CASE c_nationkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"
RANGE_SQL = ", ".join(f"('{s}', {lo}, {hi})" for s, spans in P.POSTCODE_RANGES.items() for lo, hi in spans)


@plan("postcode_ranges", f"""
WITH c AS (SELECT c_custkey, {STATE_SQL} AS state, CAST(c_custkey * 131 % 10000 AS INTEGER) AS code, -50.0 + (c_custkey * 7 % 4500) / 100.0 AS lat, 110.0 + (c_custkey * 13 % 7000) / 100.0 AS lng, c_nationkey < 12 AS nz FROM customer),
r(state, lo, hi) AS (VALUES {RANGE_SQL})
SELECT c_custkey, NOT EXISTS (SELECT 1 FROM r WHERE r.state=c.state AND code BETWEEN lo AND hi) AS outside_state,
 NOT CASE WHEN nz THEN lat BETWEEN -47.5 AND -33 AND lng BETWEEN 165 AND 179.5 ELSE lat BETWEEN -44.5 AND -10 AND lng BETWEEN 112 AND 154.5 END AS outside_box FROM c
""")
def postcode_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("c_nationkey") % 8 + 1).cast("int"))
    code = F.lpad((k * 131 % 10000).cast("string"), 4, "0")
    country = F.when(F.col("c_nationkey") < 12, F.lit("NZ")).otherwise(F.lit("AU"))
    lat, lng = F.lit(-50.0) + (k * 7 % 4500) / 100.0, F.lit(110.0) + (k * 13 % 7000) / 100.0
    return c.select("c_custkey", rules.postcode_outside_state(state, code).alias("outside_state"), rules.outside_box(country, lat, lng).alias("outside_box"))


@plan("eligibility_rules", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN false WHEN c_nationkey < 12 THEN c_mktsegment='BUILDING' ELSE c_mktsegment<>'BUILDING' END AS conflict,
 c_mktsegment IN ('MACHINERY','AUTOMOBILE') AS bad_types FROM customer
""")
def eligibility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    country = F.when(F.col("c_nationkey") < 12, F.lit("NZ")).otherwise(F.lit("AU"))
    own = F.when(F.col("c_nationkey") < 12, F.lit("nz-whv-extension")).otherwise(F.lit("au-417-specified-work"))
    none = F.col("c_acctbal") < 0
    scheme = F.when(none, F.lit("none")).otherwise(own)
    cls = F.when(none, F.lit("not-applicable")).otherwise(F.lit("conditional"))
    seg = F.col("c_mktsegment")
    types = F.when(seg == "MACHINERY", F.array(F.lit("mining"), F.lit("mining"))).when(seg == "AUTOMOBILE", F.array(F.lit("cars"))).otherwise(F.array(F.lit("mining"), F.lit("nursery")))
    return c.select(
        "c_custkey", rules.eligibility_conflict(country, scheme, cls, F.lit(True), seg == "BUILDING").alias("conflict"),
        rules.bad_enum_array(types, P.WORK_TYPES).alias("bad_types"),
    )


@plan("source_hosts", """
SELECT s_suppkey, CASE WHEN s_nationkey < 6 THEN s_acctbal < 0 WHEN s_nationkey < 12 THEN s_acctbal >= 0 WHEN s_nationkey < 18 THEN false ELSE s_acctbal >= 0 END AS conflict FROM supplier
""")
def source_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_table(spark, sf_dir, "supplier")
    n, ok = F.col("s_nationkey"), F.col("s_acctbal") >= 0
    kind = F.when(n < 6, F.lit("government-register")).when(n < 12, F.lit("industry-association")).when(n < 18, F.lit("employer-official")).otherwise(F.lit("verified-local-producer"))
    host = (
        F.when(n < 6, F.when(ok, F.lit("www.mbie.govt.nz")).otherwise(F.lit("govt.nz.example.com")))
        .when(n < 12, F.when(ok, F.lit("growers.example.org")).otherwise(F.lit("www.nzkgi.org.nz")))
        .when(n < 18, F.lit("acme.co.nz")).otherwise(F.when(ok, F.lit("acme.co.nz")).otherwise(F.lit("stats.govt.nz")))
    )
    return s.select("s_suppkey", rules.source_host_conflict(kind, F.lit("NZ"), host).alias("conflict"))


@plan("override_upsert", """
SELECT p_partkey, CASE WHEN p_type='PROMO' THEN 'overridden' ELSE p_brand END AS p_brand, CASE WHEN p_type='PROMO' AND p_size > 25 THEN 99 ELSE p_size END AS p_size, p_type='PROMO' AS overridden FROM part
""")
def override_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    o = p.filter("p_type = 'PROMO'").select("p_partkey", F.lit("overridden").alias("p_brand"), F.when(F.col("p_size") > 25, F.lit(99)).alias("p_size"))
    return R.override_upsert(p, o, "p_partkey", ["p_brand", "p_size"]).drop("p_type")


@plan("unknown_overrides", """
SELECT CAST(-p_partkey - 1 AS VARCHAR) AS entity_id, 'UNKNOWN_KEY' AS code FROM part WHERE p_type='ECONOMY'
""")
def unknown_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part")
    o = p.select(F.when(F.col("p_type") == "ECONOMY", -F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("p_partkey"))
    return R.unknown_overrides(p, o, "p_partkey").select("entity_id", "code")


@plan("enum_labels", """
WITH p AS (SELECT p_partkey, p_name, p_type, p_brand, CASE p_type WHEN 'SMALL' THEN '광업' WHEN 'LARGE' THEN '농장/원예' ELSE lower(p_type) END AS label FROM part)
SELECT p_partkey, CASE label WHEN '광업' THEN 'mining' WHEN '농장/원예' THEN 'horticulture' ELSE label END AS work_type,
 trim(regexp_replace(lower(p_name || ' & ' || p_brand || '!'),'&',' and ','g')) <> '' AS named,
 replace(lower(p_name),' ','-') || '-and-' || replace(lower(p_brand),'#','-') AS slug,
 'nz-' || replace(lower(p_name),' ','-') || '-and-' || replace(lower(p_brand),'#','-') || '-' || substr(sha256('NZ' || chr(0) || 'x' || chr(0) || p_name || ' & ' || p_brand || chr(0) || p_partkey),1,8) AS stable_id,
 CASE WHEN p_type='SMALL' THEN 'region' ELSE 'town' END AS precision FROM p
""")
def enum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part")
    t = F.col("p_type")
    label = F.when(t == "SMALL", F.lit("광업")).when(t == "LARGE", F.lit("농장/원예")).otherwise(F.lower(t))
    name = F.concat_ws(" & ", "p_name", "p_brand")
    place = F.when(t == "SMALL", F.lit("Hunter Valley")).otherwise(F.lit("Gatton"))
    return p.select(
        "p_partkey", text.work_type(label).alias("work_type"), (text.norm_name(name) != "").alias("named"), text.slug(name).alias("slug"),
        fingerprints.stable_id(F.lit("NZ"), F.lit("x"), name, F.col("p_partkey").cast("string")).alias("stable_id"),
        text.precision_of(F.lit("AU"), place).alias("precision"),
    )


@plan("register_rows", """
SELECT CAST(s_suppkey AS VARCHAR) AS record_id, s_name AS name, s_suppkey || ' Main Road' AS address, CASE WHEN s_acctbal >= 0 THEN -36.5 - s_nationkey END AS lat,
 CASE WHEN s_acctbal >= 0 THEN 170.0 + s_nationkey END AS lng, '2026-07-0' || (1 + s_suppkey % 9) AS effective_to, CASE WHEN s_nationkey < 12 THEN 'https://s.nz' END AS website FROM supplier
""")
def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_table(spark, sf_dir, "supplier")
    n = F.col("s_nationkey")
    point = F.when(F.col("s_acctbal") >= 0, F.concat_ws(", ", (F.lit(-36.5) - n).cast("string"), (F.lit(170.0) + n).cast("string"))).otherwise(F.lit("unknown"))

    def item(title, value):
        return F.struct(F.lit(title).alias("Title"), value.cast("string").alias("Value"))

    fields = F.array(
        item("Physical address", F.concat(F.col("s_suppkey").cast("string"), F.lit("  Main\nRoad "))), item("Location", point),
        item("Status expiry date", F.concat((F.col("s_suppkey") % 9 + 1).cast("string"), F.lit(" JULY 2026"))), item("Website", F.when(n < 12, F.lit(" https://s.nz "))),
    )
    out = unnest_field_list(s.withColumn("fields", F.to_json(fields)), "s_suppkey", "s_name", "fields")
    return out.withColumn("effective_to", F.col("effective_to").cast("string"))


def evidence_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    cls = (
        F.when(seg == "BUILDING", F.lit("register")).when(seg == "MACHINERY", F.lit("industry-list")).when(seg == "FURNITURE", F.lit("membership"))
        .when(seg == "HOUSEHOLD", F.lit("unverified")).otherwise(F.lit("government-job-gateway"))
    )
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_nationkey") < 12, F.lit("NZ")).otherwise(F.lit("AU")).alias("country"),
        cls.alias("source_class"), F.lit("official-web-reviewed").alias("source_kind"), F.concat(F.lit("https://s"), F.col("c_nationkey").cast("string"), F.lit(".nz")).alias("source_url"),
        F.when(F.col("c_acctbal") < 0, F.lit("none")).otherwise(F.lit("company")).alias("contact_kind"), F.when(F.col("c_nationkey") < 5, F.lit("region")).otherwise(F.lit("town")).alias("precision"),
    )


EVIDENCE_SQL = """
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey < 12 AS nz, c_nationkey AS n, c_acctbal < 0 AS silent, c_mktsegment AS seg FROM customer),
b AS (SELECT 'evidence-' || id AS binding_id, CASE seg WHEN 'BUILDING' THEN 'cohort-register' WHEN 'MACHINERY' THEN 'cohort-industry-list' WHEN 'FURNITURE' THEN 'cohort-membership'
   ELSE 'source-official-web-reviewed-' || substr(sha256('official-web-reviewed' || chr(0) || 'https://s' || n || '.nz'),1,12) END AS source_id,
  CASE seg WHEN 'BUILDING' THEN 'machine-extracted' WHEN 'MACHINERY' THEN 'machine-extracted' WHEN 'FURNITURE' THEN 'hybrid' WHEN 'HOUSEHOLD' THEN 'limited-candidate' ELSE 'reviewed-snapshot' END AS level,
  CASE WHEN seg='BUILDING' THEN 'entity,expiry,location' WHEN silent THEN 'entity,location' ELSE 'contact,entity,location' END AS scopes,
  CASE WHEN seg='BUILDING' THEN 'registered-address' WHEN seg='MACHINERY' THEN 'listed-operating-area' WHEN n < 5 THEN 'reviewed-service-area' ELSE 'reviewed-worksite' END AS location_scope,
  'directory-not-current-vacancy,' || CASE WHEN nz THEN 'role-eligibility-unverified' ELSE 'role-and-postcode-eligibility-unverified' END || CASE seg WHEN 'BUILDING' THEN ',registered-address-not-worksite'
   WHEN 'MACHINERY' THEN '' WHEN 'FURNITURE' THEN ',membership-does-not-prove-worksite,location-reviewed-snapshot-not-live-extracted' WHEN 'HOUSEHOLD' THEN ',reviewed-snapshot-not-live-extracted,official-status-unverified'
   ELSE ',reviewed-snapshot-not-live-extracted,gateway-not-employer' END AS limitations FROM c)
"""


@plan("evidence_bindings", EVIDENCE_SQL + "SELECT * FROM b")
def evidence_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.evidence_bindings(evidence_input(spark, sf_dir))
    return b.select("binding_id", "source_id", "level", F.array_join("scopes", ",").alias("scopes"), "location_scope", F.array_join("limitations", ",").alias("limitations"))


@plan("evidence_audit", EVIDENCE_SQL + """
SELECT count(DISTINCT binding_id) AS entities, count(*) AS bindings, count(DISTINCT source_id) AS sources, count(*) FILTER (WHERE level='machine-extracted') AS machine_extracted,
 count(*) FILTER (WHERE level='hybrid') AS hybrid, count(*) FILTER (WHERE level='reviewed-snapshot') AS reviewed_snapshot, count(*) FILTER (WHERE level='limited-candidate') AS limited_candidate,
 count(*) FILTER (WHERE level IN ('machine-extracted','hybrid')) AS exact_entity, count(*) FILTER (WHERE level='machine-extracted') AS exact_location,
 count(*) FILTER (WHERE level IN ('hybrid','reviewed-snapshot')) AS reviewed_location, count(*) FILTER (WHERE level='limited-candidate') AS limited_location,
 count(*) FILTER (WHERE scopes LIKE 'contact%') AS contact_scope, count(*) AS with_limitations, count(DISTINCT CASE WHEN level IN ('machine-extracted','hybrid') THEN source_id END) AS machine_sources FROM b
""")
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.evidence_audit(E.evidence_bindings(evidence_input(spark, sf_dir)))


@plan("normalize_directory", f"""
WITH s AS (SELECT *, CASE WHEN s_acctbal < 0 THEN 'Bay of Plenty' WHEN s_nationkey < 12 THEN s_suppkey || ' Main Road' ELSE 'Gatton' END AS place, CASE WHEN s_nationkey < 12 THEN 'register' ELSE 'list' END AS src,
  -47.0 + (s_suppkey * 37 % 1300) / 100.0 AS lat, 166.0 + (s_suppkey * 91 % 1300) / 100.0 AS lng FROM supplier), r(i, rn, rlat, rlng) AS (VALUES {CENTRES_SQL}),
g AS (SELECT s_suppkey, arg_min(rn, {_hav('lat', 'lng', 'rlat', 'rlng')}) AS region FROM s, r GROUP BY 1)
SELECT 'nz-' || replace(lower(s_name),'#','-') || '-' || substr(sha256('NZ' || chr(0) || src || chr(0) || s_name || chr(0) || place),1,8) AS id, region,
 CASE WHEN s_nationkey >= 12 AND s_acctbal < 0 THEN 'region' ELSE 'town' END AS precision, CASE WHEN src='register' THEN 'government-register' ELSE 'industry-association' END AS source_kind,
 CASE WHEN s_nationkey < 12 OR place LIKE '%Main%' THEN place END AS address, CASE WHEN s_suppkey % 9 < 5 THEN 'expired' ELSE 'active' END AS status, 'mining' AS work_type,
 CASE WHEN s_nationkey < 6 THEN 'none' WHEN s_nationkey < 12 THEN 'email' ELSE 'recruitment' END AS contact_kind
FROM s JOIN g USING (s_suppkey)
""")
def normalize_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load_table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    legacy = s.select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 0, F.lit("Bay of Plenty")).when(n < 12, F.concat(k.cast("string"), F.lit(" Main Road"))).otherwise(F.lit("Gatton")).alias("place"),
        F.lit("광업").alias("type"), F.when(n < 12, F.lit("register")).otherwise(F.lit("list")).alias("source"),
        F.concat((k % 9 + 14).cast("string"), F.lit(" july 2026")).alias("expiry"),
        F.when(n < 6, F.lit(None)).when(n < 12, F.lit("mailto:a@b.nz")).otherwise(F.lit("https://b.nz/jobs")).cast("string").alias("contact"),
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("postcode"),
        (F.lit(-47.0) + (k * 37 % 1300) / 100.0).alias("lat"), (F.lit(166.0) + (k * 91 % 1300) / 100.0).alias("lng"),
    )
    day = F.lit("2026-07-19").cast("date")
    out = E.normalize_directory(legacy, "NZ", day, day, F.date_add(day, 30), "https://register.govt.nz/list")
    return out.select(
        "id", "location.region", "location.precision", F.col("source.kind").alias("source_kind"), "location.address", "status",
        F.col("workTypes")[0].alias("work_type"), F.col("contact.kind").alias("contact_kind"),
    )
