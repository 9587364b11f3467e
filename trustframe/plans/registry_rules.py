"""Rule checks over the standard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import dates, urls
from trustframe.operators import ranking, rules
from trustframe.operators.issues import Rule, issue_counts, issue_rows, run_rules, union_issues
from trustframe.operators.registries import claim_issues, directory_issues
from trustframe.plans.registry import plan
from trustframe.session import load_table, spread

SEVERITY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'medium'
  WHEN '3-MEDIUM' THEN 'medium' ELSE 'minor' END"""


def severity():
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("critical"))
        .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), F.lit("medium"))
        .otherwise(F.lit("minor"))
    )


def order_rules(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    reason = F.when(F.col("o_totalprice") <= 400000, F.lit("reviewed"))
    end = F.when(F.col("o_totalprice") < 50000, F.date_add(day, 10))
    return run_rules(orders, "orders", F.col("o_orderkey"), [
        Rule("STATUS", "o_orderstatus", rules.not_in(F.col("o_orderstatus"), ["O", "F"]), F.col("o_orderstatus"), "O or F"),
        Rule("FUTURE", "o_orderdate", rules.in_future(day, F.lit("2001-01-01").cast("date")), F.date_format("o_orderdate", "yyyy-MM-dd"), "not after 2001-01-01"),
        Rule("PRIORITY", "o_orderpriority", rules.not_matching(F.col("o_orderpriority"), "[0-9]-[A-Z]+"), F.col("o_orderpriority"), "digit-NAME"),
        Rule("REASON", "reason", rules.required_when(F.col("o_orderstatus") == "F", reason), None, "reason when F"),
        Rule("END_DAY", "effective_to", rules.forbidden_when(F.col("o_orderstatus") == "O", end), F.date_format(end, "yyyy-MM-dd"), "no end day when O"),
        Rule("FINITE", "o_totalprice", rules.not_finite(F.col("o_totalprice")), F.col("o_totalprice"), "finite"),
    ])


def customer_rules(customers: DataFrame) -> DataFrame:
    return run_rules(customers, "customers", F.col("c_custkey"), [
        Rule("SEGMENT_TEXT", "c_mktsegment", rules.unsafe_text(F.col("c_mktsegment"), 9), F.col("c_mktsegment"), "up to 9 characters"),
        Rule("BALANCE", "c_acctbal", F.col("c_acctbal") < 0, F.col("c_mktsegment"), "not negative"),
        Rule("NAME", "c_name", rules.blank(F.col("c_name")), F.col("c_name"), "text"),
    ])


@plan("rule_issues", """
SELECT 'orders' AS "check", 'STATUS' AS code, CAST(o_orderkey AS VARCHAR) AS entity_id, 'o_orderstatus' AS field, o_orderstatus AS actual
FROM orders WHERE o_orderstatus NOT IN ('O','F')
UNION ALL SELECT 'orders','FUTURE',CAST(o_orderkey AS VARCHAR),'o_orderdate',strftime(o_orderdate,'%Y-%m-%d') FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2001-01-01'
UNION ALL SELECT 'orders','PRIORITY',CAST(o_orderkey AS VARCHAR),'o_orderpriority',o_orderpriority FROM orders WHERE NOT regexp_full_match(o_orderpriority,'[0-9]-[A-Z]+')
UNION ALL SELECT 'orders','REASON',CAST(o_orderkey AS VARCHAR),'reason',NULL FROM orders WHERE o_orderstatus='F' AND NOT (o_totalprice <= 400000)
UNION ALL SELECT 'orders','END_DAY',CAST(o_orderkey AS VARCHAR),'effective_to',strftime(CAST(o_orderdate AS DATE) + 10,'%Y-%m-%d') FROM orders WHERE o_orderstatus='O' AND o_totalprice < 50000
UNION ALL SELECT 'customers','SEGMENT_TEXT',CAST(c_custkey AS VARCHAR),'c_mktsegment',c_mktsegment FROM customer WHERE length(c_mktsegment) > 9
UNION ALL SELECT 'customers','BALANCE',CAST(c_custkey AS VARCHAR),'c_acctbal',c_mktsegment FROM customer WHERE c_acctbal < 0
""")
def rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = union_issues([order_rules(load_table(spark, sf_dir, "orders")), customer_rules(load_table(spark, sf_dir, "customer"))])
    return issues.select("check", "code", "entity_id", "field", "actual")


@plan("trust_audit", f"""
WITH a AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders),
o AS (SELECT *, {SEVERITY} AS sev FROM orders),
firsts AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS k FROM orders GROUP BY 1,2)
SELECT 'orders' AS "check", 'STATUS' AS code, count(*) AS issues FROM o WHERE o_orderstatus NOT IN ('O','F') HAVING count(*)>0
UNION ALL SELECT 'orders','STALE',count(*) FROM o, a WHERE date_diff('day', CAST(o_orderdate AS DATE), as_of) > CASE WHEN sev='critical' THEN 45 ELSE 90 END HAVING count(*)>0
UNION ALL SELECT 'orders','DUPLICATE',count(*) FROM orders JOIN firsts USING (o_custkey, o_orderdate) WHERE o_orderkey<>k HAVING count(*)>0
""")
def trust_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    day = F.col("o_orderdate").cast("date")
    as_of = orders.agg(F.max(day)).scalar()
    found = run_rules(orders.withColumn("as_of", as_of), "orders", F.col("o_orderkey"), [
        Rule("STATUS", "o_orderstatus", rules.not_in(F.col("o_orderstatus"), ["O", "F"]), F.col("o_orderstatus"), "O or F"),
        Rule("STALE", "o_orderdate", rules.stale(day, F.col("as_of"), severity()), day, "within its limit"),
    ])
    again = ranking.duplicate_rows(orders, ["o_custkey", "o_orderdate"], "o_orderkey")
    again = issue_rows(again, "orders", "DUPLICATE", F.col("o_orderkey"), "o_orderdate", F.col("first_ord"), "one order per customer and day")
    return issue_counts(union_issues([found, again]))


@plan("stale_by_severity", f"""
WITH a AS (SELECT max(CAST(o_orderdate AS DATE)) AS as_of FROM orders),
o AS (SELECT o_orderkey, {SEVERITY} AS severity, CAST(o_orderdate AS DATE) AS d, as_of FROM orders, a)
SELECT o_orderkey, severity, CAST(date_diff('day', d, as_of) AS BIGINT) AS age_days,
  date_diff('day', d, as_of) > CASE WHEN severity='critical' THEN 45 ELSE 90 END AS stale,
  strftime(d + 365, '%Y-%m-%d') AS due_date, CAST(greatest(date_diff('day', d + 365, as_of), 0) AS BIGINT) AS days_overdue,
  as_of > d + 365 AS overdue
FROM o
""")
def stale_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    dated = orders.withColumn("as_of", orders.agg(F.max(F.col("o_orderdate").cast("date"))).scalar())
    day = dates.strict_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    due = dates.review_due(day, 365)
    return dated.select(
        "o_orderkey", severity().alias("severity"), F.datediff("as_of", day).cast("bigint").alias("age_days"),
        rules.stale(day, F.col("as_of"), severity()).alias("stale"), F.date_format(due, "yyyy-MM-dd").alias("due_date"),
        dates.days_overdue(due, F.col("as_of")).cast("bigint").alias("days_overdue"),
        rules.review_overdue(day, F.lit(365), F.col("as_of")).alias("overdue"),
    )


@plan("date_modes", """
WITH l AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS od, o_orderstatus AS st, o_orderpriority AS pr, hi,
  CASE WHEN o_orderstatus<>'P' THEN CAST(o_orderdate AS DATE) END AS ef,
  CASE WHEN o_orderstatus='P' OR o_orderpriority='5-LOW' THEN lo END AS cur,
  CASE WHEN o_orderpriority<>'1-URGENT' THEN 'not published' END AS why,
  CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active' ELSE 'uncertain' END AS status,
  CASE WHEN o_orderpriority='5-LOW' THEN 'unverified' ELSE 'employer-official' END AS kind
  FROM orders LEFT JOIN l ON o_orderkey=l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, code FROM (
  SELECT o_orderkey, 'DATE_MODE' AS code FROM c WHERE (ef IS NOT NULL) = (cur IS NOT NULL AND why IS NOT NULL)
  UNION ALL SELECT o_orderkey, 'RANGE' FROM c WHERE ef > hi
  UNION ALL SELECT o_orderkey, 'CURRENT_ORDER' FROM c WHERE cur > od
  UNION ALL SELECT o_orderkey, 'UNZONED' FROM c WHERE st='O'
  UNION ALL SELECT o_orderkey, 'ELAPSED_NOT_EXPIRED' FROM c WHERE hi < DATE '1999-01-01' AND status<>'expired'
  UNION ALL SELECT o_orderkey, 'EXPIRED_NOT_ELAPSED' FROM c WHERE status='expired' AND (hi IS NULL OR hi >= DATE '1999-01-01')
  UNION ALL SELECT o_orderkey, 'REVIEW_PASSED' FROM c WHERE status IN ('active','uncertain') AND od + 90 < DATE '1999-01-01'
  UNION ALL SELECT o_orderkey, 'UNVERIFIED_PROMOTED' FROM c WHERE kind='unverified' AND status<>'uncertain')
""")
def date_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = load_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.col("l_shipdate").cast("date")).alias("lo"), F.max(F.col("l_shipdate").cast("date")).alias("hi")
    )
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    st, pr, day = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate").cast("date")
    c = o.join(ship, o["o_orderkey"] == ship["l_orderkey"], "left").select(
        "o_orderkey", "hi", day.alias("od"), F.when(st != "P", day).alias("ef"),
        F.when((st == "P") | (pr == "5-LOW"), F.col("lo")).alias("cur"),
        F.when(pr != "1-URGENT", F.lit("not published")).alias("why"),
        F.when(st == "F", F.lit("expired")).when(st == "O", F.lit("active")).otherwise(F.lit("uncertain")).alias("status"),
        F.when(pr == "5-LOW", F.lit("unverified")).otherwise(F.lit("employer-official")).alias("kind"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"), F.when(st == "O", F.lit("")).otherwise(F.lit("Z"))).alias("stamp"),
    )
    as_of = F.lit("1999-01-01").cast("date")
    problems = rules.lifecycle_problems(F.col("status"), F.col("hi"), F.date_add("od", 90), F.col("kind"), as_of)
    found = [
        Rule("DATE_MODE", "effective_from", rules.date_mode_conflict(F.col("ef"), F.col("cur"), F.col("why"))),
        Rule("RANGE", "effective_to", rules.out_of_order(F.col("ef"), F.col("hi"))),
        Rule("CURRENT_ORDER", "current_as_of", rules.out_of_order(F.col("cur"), F.col("od"))),
        Rule("UNZONED", "stamp", dates.zoned_timestamp(F.col("stamp")).isNull()),
    ]
    found += [Rule(code, "status", broken) for code, broken in problems.items()]
    return run_rules(c, "dates", F.col("o_orderkey"), found).select("entity_id", "code")


@plan("duplicate_rows", """
WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events),
f AS (SELECT user_id, event_type, day, min(event_id) AS first_ord FROM e GROUP BY 1,2,3)
SELECT event_id, user_id, event_type, strftime(day,'%Y-%m-%d') AS day, first_ord FROM e JOIN f USING (user_id, event_type, day) WHERE event_id<>first_ord
""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"))
    return ranking.duplicate_rows(e, ["user_id", "event_type", "day"], "event_id")


@plan("occurrence_numbers", """
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS occurrence FROM events
""")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = ranking.occurrence_number(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], F.col("ts").cast("date"))
    return out.select("event_id", "occurrence")


@plan("last_write_wins", """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1,2
""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return ranking.last_write_wins(e.withColumn("ord", F.col("event_id")), ["user_id", "event_type"], "ord").drop("ord")


@plan("order_violations", """
WITH w AS (SELECT o_orderkey, o_custkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM orders)
SELECT o_orderkey, o_custkey FROM w WHERE o_orderdate < seen
""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = ranking.order_violations(o, ["o_custkey"], "o_orderkey", "o_orderdate", F.floor(F.col("o_orderkey") / 1000))
    return out.select("o_orderkey", "o_custkey")


URL_SQL = r"""
WITH u AS (SELECT page_id, url,
  lower(regexp_extract(url,'^([A-Za-z][A-Za-z0-9+.-]*):',1)) AS scheme,
  lower(regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)',1)) AS host,
  regexp_extract(url,'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)',1) AS path,
  regexp_extract(url,'(\?[^#]*)',1) AS q, regexp_extract(url,'(#.*)$',1) AS frag FROM pages)
"""


@plan("url_policy", URL_SQL + r"""
SELECT page_id, scheme='https' AND host<>'' AND length(frag)<=1 AS is_https, host,
  CASE WHEN regexp_extract(host,'([^.]*\.[^.]*)$',1)='' THEN host ELSE regexp_extract(host,'([^.]*\.[^.]*)$',1) END AS site,
  host='example.com' OR host LIKE '%.example.com' OR host='example.org' OR host LIKE '%.example.org' AS allowed,
  scheme || '://' || host || path || CASE WHEN length(q)>1 THEN q ELSE '' END || CASE WHEN length(frag)>1 THEN frag ELSE '' END AS normalized,
  'https://' || host || CASE WHEN rtrim(path,'/')='' THEN '/' ELSE rtrim(path,'/') END || CASE WHEN length(q)>1 THEN q ELSE '' END AS contact,
  'sha256:' || sha256(url || chr(0) || 'GET' || chr(0)) AS request_key
FROM u
""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    return p.select(
        "page_id", urls.is_https(u).alias("is_https"), urls.host(u).alias("host"),
        urls.registrable_host(urls.host(u)).alias("site"),
        urls.host_under(urls.host(u), ["example.com", "example.org"]).alias("allowed"),
        urls.normalize_source_url(u).alias("normalized"), urls.canonical_contact(F.lit("company"), u).alias("contact"),
        urls.request_key(u, F.lit("GET"), F.lit(None).cast("string")).alias("request_key"),
    )


@plan("contact_policy", """
WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'mailto:Sales Desk@example.com' WHEN s_nationkey < 12 THEN 'mailto:' || lower(replace(s_name,'#','')) || '@mail' || s_nationkey || '.co.nz'
   ELSE 'https://www.site' || s_nationkey || '.co.nz/jobs' END AS contact, 'https://site' || (s_nationkey // 2 * 2) || '.co.nz/about' AS source, s_nationkey FROM supplier)
SELECT s_suppkey, CASE WHEN contact LIKE 'mailto:%' THEN 'email' ELSE 'recruitment' END AS kind,
  contact LIKE 'mailto:%' AND contact NOT LIKE '% %' AS mail_ok, contact LIKE 'https:%' AS web_ok,
  CASE WHEN contact LIKE 'mailto:%' THEN CASE WHEN contact LIKE '%@mail%' THEN true ELSE 'example.com' <> 'site' || (s_nationkey // 2 * 2) || '.co.nz' END
    ELSE s_nationkey <> s_nationkey // 2 * 2 END AS other_site
FROM s
""")
def contact_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trustframe.functions.text import contact_kind

    s = load_table(spark, sf_dir, "supplier")
    even = (F.floor(F.col("s_nationkey") / 2) * 2).cast("string")
    contact = (
        F.when(F.col("s_acctbal") < 0, F.lit("mailto:Sales Desk@example.com"))
        .when(F.col("s_nationkey") < 12, F.concat(F.lit("mailto:"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit(""))), F.lit("@mail"), F.col("s_nationkey"), F.lit(".co.nz")))
        .otherwise(F.concat(F.lit("https://www.site"), F.col("s_nationkey"), F.lit(".co.nz/jobs")))
    )
    source = F.concat(F.lit("https://site"), even, F.lit(".co.nz/about"))
    rows = s.select("s_suppkey", contact.alias("contact"), source.alias("source"))
    c = F.col("contact")
    return rows.select(
        "s_suppkey", contact_kind(c).alias("kind"), urls.is_mailto(c).alias("mail_ok"), urls.is_https(c).alias("web_ok"),
        rules.other_registrable_host(F.col("source"), c).alias("other_site"),
    )


@plan("path_policy", r"""
WITH p AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '/' || p_name WHEN 'STANDARD' THEN 'a/../../' || p_name WHEN 'PROMO' THEN 'a/../b/' || p_name ELSE 'nz/./' || p_name END AS path, p_type FROM part)
SELECT p_partkey, p_type IN ('ECONOMY','STANDARD') AS escapes FROM p
""")
def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    t = F.col("p_type")
    path = (
        F.when(t == "ECONOMY", F.concat(F.lit("/"), "p_name")).when(t == "STANDARD", F.concat(F.lit("a/../../"), "p_name"))
        .when(t == "PROMO", F.concat(F.lit("a/../b/"), "p_name")).otherwise(F.concat(F.lit("nz/./"), "p_name"))
    )
    return p.select("p_partkey", rules.path_escapes(path).alias("escapes"))


def registry_rows(df: DataFrame, text: Column) -> DataFrame:
    """Rows as the strict reader gives them: ord, row VARIANT, row_json."""
    return df.select(F.col("ord"), F.try_parse_json(text).alias("row"), text.alias("row_json"))


_ENTRY = (
    '{"id":"nz-%s","country":"NZ","name":"Acme","location":{"label":"Te Puke","region":"Bay of Plenty","lat":%s,"lng":176.3,"precision":"town"%s},"workTypes":["packhouse"],'
    '"source":{"kind":"industry-association","url":"https://www.nzkgi.org.nz/list","checkedAt":"2026-07-19"%s},"contact":{"kind":"none"%s},"status":"active",'
    '"nextReviewAt":"2026-08-18","vacancyStatus":"directory-only","eligibility":{"scheme":"nz-whv-extension","classification":"conditional",%s"requiresLocationCheck":false}}'
)


@plan("directory_registry", """
WITH c AS (SELECT c_custkey AS k, 'nz-' || c_custkey AS entity_id FROM customer)
SELECT entity_id, 'LOCATION_KEYS' AS code, 'location' AS field FROM c WHERE k % 8 = 1 UNION ALL SELECT entity_id, 'BOX', 'lat/lng' FROM c WHERE k % 8 = 2
UNION ALL SELECT entity_id, 'TEXT', 'address' FROM c WHERE k % 8 = 3 UNION ALL SELECT entity_id, 'CONTACT_KEYS', 'contact' FROM c WHERE k % 8 = 4
UNION ALL SELECT entity_id, 'NUMBER', 'lat' FROM c WHERE k % 8 = 5 UNION ALL SELECT entity_id, 'ELIGIBILITY_KEYS', 'eligibility' FROM c WHERE k % 8 = 6
UNION ALL SELECT entity_id, 'ELIGIBILITY', 'eligibility' FROM c WHERE k % 8 = 6 UNION ALL SELECT entity_id, 'SOURCE_KEYS', 'source' FROM c WHERE k % 8 = 7
""")
def directory_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per customer; seven in eight break a key or text rule of one of its parts."""
    k = F.col("c_custkey")
    odd = lambda n, text, rest="": F.when(k % 8 == n, F.lit(text)).otherwise(F.lit(rest))
    lat = F.when(k % 8 == 2, F.lit("-10.5")).when(k % 8 == 5, F.lit('"-37.7"')).otherwise(F.lit("-37.7"))
    more = F.when(k % 8 == 1, F.lit(',"zip":"1"')).when(k % 8 == 3, F.lit(',"address":" "')).otherwise(F.lit(""))
    text = F.format_string(_ENTRY, k.cast("string"), lat, more, odd(7, ',"note":1'), odd(4, ',"tel":"1"'), odd(6, "", '"requiresRoleCheck":true,'))
    c = spread(load_table(spark, sf_dir, "customer").select(k.alias("ord"), k), "c_custkey")
    rows = registry_rows(c, text)
    return directory_issues(rows, F.lit("2026-07-19").cast("date")).select("entity_id", "code", "field")


_CLAIM = (
    '{"id":"c%s","country":"%s","locale":"ko","category":"fee","label":"Fee","value":%s,"unit":"NZD","status":"official","verifiedAt":"%s","effectiveFrom":"2026-01-01",'
    '"sourceUrl":"https://%s/x","pages":["nz/index.html"],"severity":"critical","parityKey":"k%s"}'
)


@plan("claim_registry", """
WITH p AS (SELECT p_partkey AS k, 'c' || p_partkey AS entity_id FROM part)
SELECT entity_id, 'STALE' AS code, 'verifiedAt' AS field FROM p WHERE k % 7 = 1 UNION ALL SELECT entity_id, 'HOST', 'sourceUrl' FROM p WHERE k % 7 = 2 UNION ALL SELECT entity_id, 'VALUE', 'value' FROM p WHERE k % 7 = 3
UNION ALL SELECT entity_id, 'COUNTRY', 'country' FROM p WHERE k % 7 = 4 UNION ALL SELECT entity_id, 'NO_MARKER', 'pages' FROM p WHERE k % 7 = 5
UNION ALL SELECT p.entity_id, 'PARITY', 'parityKey' FROM p JOIN (SELECT k // 20 AS g, min(k) AS first FROM p WHERE k % 7 <> 3 GROUP BY 1) f ON p.k // 20 = f.g WHERE p.k % 7 <> 3 AND (p.k % 7 = 6) <> (f.first % 7 = 6)
""")
def claim_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per part, checked against the markers of its page; twenty parts share a parity key."""
    k = F.col("p_partkey")
    pick = lambda n, text, rest: F.when(k % 7 == n, F.lit(text)).otherwise(F.lit(rest))
    value = F.when(k % 7 == 3, F.lit("[1]")).when(k % 7 == 6, F.lit("901")).otherwise(F.lit("900.0"))
    text = F.format_string(
        _CLAIM, k.cast("string"), pick(4, "ZZ", "NZ"), value, pick(1, "2026-06-03", "2026-06-04"), pick(2, "immigration.govt.nz.evil.com", "www.immigration.govt.nz"), F.floor(k / 20).cast("string"))
    p = spread(load_table(spark, sf_dir, "part").select(k.alias("ord"), k), "p_partkey")
    markers = p.filter(k % 7 != 5).select(F.lit("nz/index.html").alias("page"), F.concat(F.lit("c"), k.cast("string")).alias("marker"))
    return claim_issues(registry_rows(p, text), markers, F.lit("2026-07-19").cast("date")).select("entity_id", "code", "field")
