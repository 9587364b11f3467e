"""Numeric facts, amounts, coverage and wording over documents, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import classify, fingerprints, numbers, text
from trustframe.operators import coverage as C
from trustframe.operators import ranking, rules
from trustframe.functions.dates import cohort_date
from trustframe.plans.registry import plan
from trustframe.session import load_table, spread

TOKEN = r"\b(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?[kKmM]?\b"
NUMBER_SQL = rf"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS t FROM documents),
num AS (SELECT doc_id, CASE lower(right(t,1)) WHEN 'k' THEN 3 WHEN 'm' THEN 6 ELSE 0 END AS s, regexp_replace(replace(t,',',''),'[kKmM]$','') AS d FROM tok),
par AS (SELECT doc_id, s, split_part(d,'.',1) AS w, split_part(d,'.',2) || repeat('0', CAST(greatest(s - length(split_part(d,'.',2)), 0) AS INTEGER)) AS f FROM num),
can AS (SELECT doc_id, CASE WHEN ltrim(w || substr(f,1,s),'0') = '' THEN '0' ELSE ltrim(w || substr(f,1,s),'0') END || CASE WHEN rtrim(substr(f,s+1),'0') = '' THEN '' ELSE '.' || rtrim(substr(f,s+1),'0') END AS number FROM par)
"""


def document_numbers(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Distinct canonical numbers of every whole text."""
    values = F.transform(numbers.number_tokens(F.col("text")), numbers.canonical_token)
    return documents.select(*keep, F.array_distinct(values).alias("numbers"))


@plan("number_facts", "WITH " + NUMBER_SQL + f"""
SELECT DISTINCT doc_id, number FROM can WHERE NOT regexp_full_match(number,'20[0-9][0-9]') AND number NOT IN ({', '.join(repr(v) for v in P.VISA_IDENTIFIERS)}) AND length(split_part(number,'.',1)) < 8
""")
def number_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_numbers(load_table(spark, sf_dir, "documents"), ["doc_id"])
    rows = d.select("doc_id", F.explode("numbers").alias("number"))
    whole = F.split_part(F.col("number"), F.lit("."), F.lit(1))
    drop = F.col("number").rlike(r"\A20\d{2}\z") | F.col("number").isin(*P.VISA_IDENTIFIERS) | (F.length(whole) >= 8)
    return rows.filter(~drop)


@plan("category_facts", """
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderkey % 40 + 1 AS w, o_custkey AS q FROM orders)
SELECT o_orderkey, 'fee' AS category, CAST(p AS VARCHAR) AS numbers FROM o WHERE NOT (p BETWEEN 2000 AND 2099) AND p NOT IN (186,189,190,191,417,462,482,485,491,500,820)
UNION ALL SELECT o_orderkey, 'processing', CAST(w AS VARCHAR) FROM o
UNION ALL SELECT o_orderkey, 'quota', CAST(q AS VARCHAR) FROM o WHERE q >= 100 AND q NOT IN (186,189,190,191,417,462,482,485,491,500,820) AND NOT (q BETWEEN 2000 AND 2099)
UNION ALL SELECT o_orderkey, 'age', '18' FROM o
""")
def category_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a sentence written for every order: dates, points and other clauses must not leak in."""
    o = spread(load_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey")
    body = F.concat(
        F.lit("Visa application fee NZD $"), F.floor("o_totalprice").cast("string"), F.lit(" from 2026-07-01. Processing time "),
        (F.col("o_orderkey") % 40 + 1).cast("string"), F.lit(" weeks + quota "), F.col("o_custkey").cast("string"), F.lit("; age 18 years old"),
    )
    rows = C.numeric_facts(o.select("o_orderkey", body.alias("body")), "body")
    return rows.select("o_orderkey", "category", F.array_join("numbers", ",").alias("numbers"))


@plan("document_contexts")
def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number token of every whole document with its clause and neighbourhood (rows only: the
    neighbourhood needs look-around, which the oracle's regular expressions lack)."""
    d = load_table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\d"))
    d = d.select("doc_id", text.collapse_ws(text.nfkc(F.col("text"))).alias("body"))
    rows = d.select("doc_id", F.explode(numbers.tokens_in_context(F.col("body"))).alias("t"))
    return rows.select("doc_id", "t.token", "t.left", "t.right", "t.clause", "t.in_date")


@plan("amount_tokens", """
WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderkey % 30 + 1 AS n, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CASE WHEN s<>'P' THEN CAST(p AS DOUBLE) END AS iso_amount, CASE WHEN s<>'P' THEN CAST(p AS DOUBLE) END AS leading_amount, CASE WHEN s<>'F' THEN CAST(n AS DOUBLE) END AS hourly,
 n / 100.0::DOUBLE AS percent_value, CASE WHEN s='O' THEN CAST(n AS DOUBLE) END AS embedded, CASE WHEN n % 30 = 0 THEN n / 30.0::DOUBLE END AS day_months, CAST(n * 12 AS DOUBLE) AS year_months,
 CAST(n AS DOUBLE) AS same_days, n || '-' || (n + 17) AS span, CAST(p AS DOUBLE) AS plain FROM o
""")
def amount_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p"), (F.col("o_orderkey") % 30 + 1).alias("n"), F.col("o_orderstatus").alias("s"))
    p, n, s = F.col("p").cast("string"), F.col("n").cast("string"), F.col("s")
    t = numbers.text_transform
    grouped = F.regexp_replace(p, r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return o.select(
        "o_orderkey",
        t("single-iso-amount-to-number", F.concat(F.lit("NZD $"), grouped, F.when(s == "P", F.lit(" or AUD 5")).otherwise(F.lit("")))).alias("iso_amount"),
        t("leading-currency-to-number", F.concat(F.when(s == "P", F.lit("about ")).otherwise(F.lit("")), F.lit("CAD $"), grouped, F.lit(" now"))).alias("leading_amount"),
        t("single-hourly-dollar-amount-to-number", F.concat(F.lit("$"), n, F.when(s == "F", F.lit(" a day")).otherwise(F.lit(" per hour")))).alias("hourly"),
        t("percent-to-decimal", F.concat(F.lit("rate "), n, F.lit(" %"))).alias("percent_value"),
        t("embedded-percent", F.concat(F.lit("$"), n, F.lit(" per $100 ("), F.when(s == "O", n).otherwise(F.lit("99.5")), F.lit("%)"))).alias("embedded"),
        t("single-duration-days-to-months", F.concat(n, F.lit(" days"))).alias("day_months"),
        t("single-duration-years-to-months", F.concat(n, F.lit(" years"))).alias("year_months"),
        t("identical-duration-days", F.concat(n, F.lit(" days before or "), n, F.lit(" days after"))).alias("same_days"),
        t("inclusive-range", F.concat(F.lit("aged "), n, F.lit(" to "), (F.col("n") + 17).cast("string"))).alias("span"),
        t("currency-to-number", F.concat(F.lit("cost "), grouped)).alias("plain"),
    )


FACT_SQL = "WITH " + NUMBER_SQL + """,
cand AS (SELECT d.doc_id, d.source, d.lang, coalesce(l.quality = 1 AND l.toxic = 1, false) AS marked FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id IN (SELECT doc_id FROM can)),
vouched AS (SELECT DISTINCT source, lang, number FROM cand JOIN can USING (doc_id) WHERE marked),
gap AS (SELECT c.doc_id FROM cand c JOIN can USING (doc_id) LEFT JOIN vouched v ON v.source=c.source AND v.lang=c.lang AND v.number=can.number WHERE v.number IS NULL GROUP BY 1),
ex AS (SELECT doc_id, CASE WHEN n_chars < 600 THEN DATE '2025-01-01' ELSE DATE '2027-01-01' END AS until FROM documents WHERE n_chars < 1500),
res AS (SELECT c.doc_id, CASE WHEN marked OR g.doc_id IS NULL THEN 'marked' WHEN until >= DATE '2026-07-19' THEN 'exempted' ELSE 'uncovered' END AS outcome, until IS NOT NULL AS known FROM cand c LEFT JOIN gap g USING (doc_id) LEFT JOIN ex USING (doc_id))
"""


def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_numbers(load_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "text"]).filter(F.size("numbers") > 0)
    lab = load_table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("marked"))
    return d.join(lab, "doc_id", "left").select(
        F.col("source").alias("page"), F.col("doc_id").cast("string").alias("selector"),
        fingerprints.fact_fingerprint(F.col("lang"), F.col("text"), normalized=True).alias("fingerprint"), F.col("lang").alias("category"),
        "numbers", F.coalesce("marked", F.lit(False)).alias("directly_marked"),
    )


def document_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_table(spark, sf_dir, "documents").filter("n_chars < 1500")
    return d.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("selector"), fingerprints.fact_fingerprint(F.col("lang"), F.col("text"), normalized=True).alias("fingerprint"),
        F.lit("reviewed").alias("reason"), F.when(F.col("lang") == "es", F.lit(" ")).otherwise(F.lit("team")).alias("owner"),
        F.when(F.col("n_chars") < 600, F.lit("2025-01-01")).otherwise(F.lit("2027-01-01")).alias("expires_at"),
    )


def document_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = document_exemptions(spark, sf_dir).select("selector", "fingerprint", F.col("expires_at").cast("date").alias("expires_at"))
    return C.coverage_outcomes(document_candidates(spark, sf_dir), ex, F.lit("2026-07-19").cast("date"))


@plan("fact_coverage", FACT_SQL + "SELECT CAST(doc_id AS VARCHAR) AS selector, outcome FROM res")
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_outcomes(spark, sf_dir).select("selector", "outcome")


@plan("coverage_totals", FACT_SQL + "SELECT outcome, count(*) AS n FROM res GROUP BY 1")
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage_totals(document_outcomes(spark, sf_dir))


@plan("exemption_issues", FACT_SQL + """
SELECT 'INVALID_EXEMPTION' AS code, count(*) AS n FROM documents WHERE n_chars < 1500 AND lang='es' HAVING count(*) > 0
UNION ALL SELECT 'EXPIRED_EXEMPTION', count(*) FROM documents WHERE n_chars < 600 AND lang<>'es' HAVING count(*) > 0
UNION ALL SELECT 'ORPHAN_EXEMPTION', count(*) FROM documents WHERE n_chars < 1500 AND lang<>'es' AND doc_id NOT IN (SELECT doc_id FROM res WHERE outcome<>'marked') HAVING count(*) > 0
""")
def exemption_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = C.exemption_issues(document_exemptions(spark, sf_dir), document_outcomes(spark, sf_dir), F.lit("2026-07-19").cast("date"))
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@plan("banned_text", r"""
SELECT doc_id, regexp_matches(text, '(?i)\b(?:licensed under|token|apply now)\b') AS banned, NOT (contains(regexp_replace(lower(text),'[^a-z0-9]+','','g'), 'licensedunder') AND contains(regexp_replace(lower(text),'[^a-z0-9]+','','g'), 'nc40')) AS tokens_missing FROM documents
""")
def banned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(
        "doc_id", rules.banned_phrase([F.col("text")], r"(?i)\b(?:licensed under|token|apply now)\b").alias("banned"),
        rules.tokens_missing(text.norm_key(F.col("text")), ["licensedunder", "nc40"]).alias("tokens_missing"),
    )


@plan("vacancy_wording", r"""
SELECT c_custkey, c_mktsegment IN ('BUILDING','MACHINERY') AS banned FROM customer
""")
def vacancy_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    label = (
        F.when(seg == "BUILDING", F.lit("Hiring NOW in Te Puke")).when(seg == "MACHINERY", F.lit("2 vacancies open")).when(seg == "FURNITURE", F.lit("Vacant Lot Farm"))
        .otherwise(F.lit("Reopening Positively"))
    )
    return c.select("c_custkey", rules.banned_phrase([F.col("c_name"), label]).alias("banned"))


@plan("text_fingerprints", """
SELECT doc_id, 'sha256:' || substr(sha256(lang || '|' || trim(regexp_replace(text,'\\s+',' ','g'))),1,20) AS fingerprint FROM documents
""")
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", fingerprints.fact_fingerprint(F.col("lang"), F.col("text")).alias("fingerprint"))


@plan("challenge_pages", """
SELECT page_id, url LIKE '%/fr/%' OR url LIKE '%/de/%' AS blocked, url LIKE '%/fr/%' AS link_blocked FROM pages
""")
def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a login form or a bot challenge put in front of their own body."""
    p = load_table(spark, sf_dir, "pages")
    u = F.col("url")
    front = F.when(u.like("%/fr/%"), F.lit('<form>LOG IN<input type="password"></form>')).when(u.like("%/de/%"), F.lit("<title>Just a moment...</title>")).otherwise(F.lit(""))
    body = F.concat(front, "html")
    return p.select("page_id", classify.challenge_page(F.lit("text/html"), body).alias("blocked"), classify.link_challenge(body).alias("link_blocked"))


@plan("cohort_guard", """
WITH n AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS newest FROM orders GROUP BY 1)
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE),'%Y-%m-%d') AS cohort, strftime(newest,'%Y-%m-%d') AS newest FROM orders JOIN n USING (o_custkey) WHERE CAST(o_orderdate AS DATE) < newest
""")
def cohort_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("From "), F.date_format("o_orderdate", "d MMMM yyyy")).alias("label"))
    rows = o.select("o_orderkey", "o_custkey", cohort_date(F.col("label")).alias("cohort"))
    out = ranking.newest_cohort_guard(rows, ["o_custkey"], "cohort")
    return out.select("o_orderkey", F.col("cohort").cast("string").alias("cohort"), F.col("newest").cast("string").alias("newest"))
