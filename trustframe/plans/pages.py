"""Page corpus queries: contracts, links, markers, elements, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.operators import coverage as C
from trustframe.operators import pages as G
from trustframe.operators import reconcile as R
from trustframe.operators import rules
from trustframe.plans.registry import plan
from trustframe.session import cut_lineage, load_table, spread
from trustframe.sources.readers import named_links

LANG = "^[a-z]+://[^/]*/([a-z]+)/"


@plan("page_contract", rf"""
WITH p AS (SELECT page_id, html, regexp_extract(url,'{LANG}',1) AS lang, regexp_extract(html,'<h1>([^<]*)</h1>',1) AS title FROM pages)
SELECT page_id, code FROM (SELECT page_id, 'DOCTYPE' AS code FROM p WHERE NOT contains(lower(substr(html,1,100)),'<!doctype html>') UNION ALL SELECT page_id, 'LANGUAGE' FROM p WHERE NOT contains(substr(html,1,300),'<html lang="' || CASE WHEN lang='es' THEN 'en' ELSE lang END || '">')
 UNION ALL SELECT page_id, 'TITLE' FROM p WHERE NOT contains(html,'<title>' || title || '</title>'))
""")
def page_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lang = F.regexp_extract("url", LANG, 1)
    wanted = F.when(lang == "es", F.lit("en")).otherwise(lang)
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return p.select("page_id", F.explode(rules.page_contract_breaks(F.col("html"), wanted, title)).alias("code"))


#: Links in every quoting, one in a comment, one without an end tag, and a name that is linked twice.
LINK_VARIANTS = "<!-- <a href=\"/gone\">gone</a> --><a href='/single'>twice</a><a href=/bare>twice</a><a title=\">\" href=\"/angle\">angle</a>"

LINK_SQL = r"""
WITH l0 AS (SELECT page_id, regexp_extract_all(html,'<a\b[^>]*href="([^"]+)"[^>]*>',1) AS hs, regexp_extract_all(html,'<a\b[^>]*href="[^"]+"[^>]*>([^<]*)</a>',1) AS ns FROM pages),
l AS (SELECT page_id, unnest(hs) AS href, unnest(ns) AS name, unnest(range(len(hs))) AS ord FROM l0
  UNION ALL SELECT page_id, v.* FROM pages, (VALUES ('/single','twice',-3), ('/bare','twice',-2), ('/angle','angle',-1)) v(href, name, ord))
"""


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit(LINK_VARIANTS), "html").alias("html"))


@plan("page_links", LINK_SQL + "SELECT href, count(DISTINCT page_id) AS pages, min(page_id) AS first_page, count(DISTINCT name) AS names FROM l GROUP BY 1")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = G.page_links(linked_pages(spark, sf_dir), "page_id", "html")
    return links.groupBy("href").agg(
        F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"), F.countDistinct("name").alias("names")
    )


@plan("named_links", LINK_SQL + """
SELECT page_id, name, arg_max(href, ord) AS href FROM l WHERE name IN (SELECT DISTINCT name FROM l WHERE href LIKE '/a%' OR href='/bare') GROUP BY 1, 2
""")
def named_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked_pages(spark, sf_dir)
    names = G.page_links(p, "page_id", "html").filter(F.col("href").like("/a%") | (F.col("href") == "/bare")).select("name").distinct()
    return named_links(p, "page_id", "html", names)


@plan("marker_gaps", LINK_SQL + """
, d AS (SELECT page_id, unnest(['/The','/and','/Nicht','/En','/gone','/bare','/angle']) AS marker FROM pages)
SELECT page_id, marker FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page_id=d.page_id AND l.href=d.marker)
""")
def marker_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = linked_pages(spark, sf_dir)
    wanted = ["/The", "/and", "/Nicht", "/En", "/gone", "/bare", "/angle"]
    declared = p.select("page_id", F.explode(F.array(*map(F.lit, wanted))).alias("marker"))
    found = G.page_markers(p, "page_id", "html", mark="href")
    return R.unmatched(declared, found, ["page_id", "marker"])


@plan("page_elements", r"""
SELECT page_id, tag, n FROM (SELECT page_id, 'p' AS tag, len(regexp_extract_all(html,'<p>')) AS n FROM pages UNION ALL SELECT page_id, 'li', len(regexp_extract_all(html,'<li>')) FROM pages
 UNION ALL SELECT page_id, 'a', len(regexp_extract_all(html,'<a ')) FROM pages UNION ALL SELECT page_id, 'h1', len(regexp_extract_all(html,'<h1>')) FROM pages) WHERE n > 0
""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.page_elements(load_table(spark, sf_dir, "pages"), "page_id", "html")
    rows = e.filter(F.col("tag").isin("p", "li", "a", "h1") & ~F.col("hidden"))
    return rows.groupBy(F.col("page").cast("bigint").alias("page_id"), "tag").agg(F.count(F.lit(1)).alias("n"))


@plan("page_fact_coverage", f"""
SELECT 'fee' AS category, 'marked' AS outcome, 3 * count(*) AS n FROM pages WHERE page_id * 10 NOT IN ({', '.join(P.VISA_IDENTIFIERS)}) AND NOT (page_id * 10 BETWEEN 2000 AND 2099) AND page_id * 10 < 10000000 HAVING count(*) > 0
UNION ALL SELECT 'quota', 'uncovered', count(*) FROM pages WHERE CAST('10' || page_id AS BIGINT) < 10000000 HAVING count(*) > 0
""")
def page_fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric facts of all page elements and their coverage; every page gets one marked fee sentence.

    Numbers of eight digits are no facts (``classify.countable``), so fees end at page 999,999 and quotas at page 99,999.
    """
    p = load_table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    front = F.concat(
        F.lit('<div data-claim-id="nz-visa-fee"><p>Visa fee NZD $'), n, F.lit("0</p></div><p>The visa fee is NZD $"), n,
        F.lit("0 today</p><p>quota 10"), n, F.lit(" places</p>"),
    )
    body = F.replace(F.col("html"), F.lit("<article>"), F.concat(F.lit("<article>"), front))
    e = G.page_elements(p.select("page_id", body.alias("html")), "page_id", "html")
    cand = C.page_candidates(e).persist()  # parsed once, read by several joins
    none = spark.createDataFrame([], "selector string, fingerprint string, expires_at date")
    out = C.coverage_outcomes(cand, none, F.lit("2026-07-19").cast("date"))
    return out.groupBy("category", "outcome").agg(F.count(F.lit(1)).alias("n"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order: a heading, a definition list, a hidden paragraph and a table."""
    o = spread(load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    qty, more = F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string")
    extra = F.when(F.col("o_orderstatus") == "P", F.lit("<td>extra</td>")).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><body><h2>Order</h2><dl><dt>Unit</dt><dd>NZD</dd><dt>Customer</dt><dd>"), qty,
        F.lit("</dd></dl><p hidden>secret</p><h3>Items</h3><table><caption>Lines</caption><tr><th>No</th><th>Qty</th><th>Rate</th></tr><tr><td>1</td><td>"),
        qty, F.lit("</td><td>5%</td></tr><tr><td>2</td><td>"), more, F.lit("</td><td>7 %</td>"), extra, F.lit("</tr></table></body></html>"),
    )
    return o.select("o_orderkey", html.alias("html"))


@plan("table_extraction", """
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus='P' THEN 1 ELSE 2 END AS BIGINT) AS rows, CAST(CASE WHEN o_orderstatus='P' THEN o_custkey ELSE 2 * o_custkey + 1 END AS BIGINT) AS quantity, CAST(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END AS BIGINT) AS partial FROM orders
""")
def table_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.page_elements(order_pages(spark, sf_dir), "o_orderkey", "html", tags=("td", "th"))
    rows = cut_lineage(G.table_rows(e))  # parsed once, read by several joins
    good, problems = G.typed_table(rows, ["No", "Qty", "Rate"], ["integer", "integer", "percent-to-decimal"])
    both = good.select("page", F.col("values")[1].alias("q"), F.lit(None).cast("string").alias("code")).unionByName(
        problems.select("page", F.lit(None).cast("double").alias("q"), "code")
    )
    return both.groupBy(F.col("page").cast("bigint").alias("o_orderkey")).agg(
        F.count("q").alias("rows"), F.coalesce(F.sum("q"), F.lit(0)).cast("bigint").alias("quantity"), F.count_if(F.col("code") == "PARTIAL_ROW").alias("partial")
    )


@plan("definition_lookup", """
SELECT o_orderkey, o_custkey AS customer, 'NZD' AS unit, CAST(0 AS BIGINT) AS hidden_found FROM orders
""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.page_elements(order_pages(spark, sf_dir), "o_orderkey", "html")
    label = F.when((F.col("tag") == "dd") & (F.col("section") == "Order") & ~F.col("hidden"), F.col("label"))
    wide = e.groupBy("page").agg(
        F.max(F.when(label == "Customer", F.col("text"))).cast("bigint").alias("customer"), F.max(F.when(label == "Unit", F.col("text"))).alias("unit"),
        F.count_if((F.col("text") == "secret") & ~F.col("hidden")).alias("hidden_found"),
    )
    return wide.select(F.col("page").cast("bigint").alias("o_orderkey"), "customer", "unit", "hidden_found")
