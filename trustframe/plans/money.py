"""Rates, probes, bracket rules, points and cash plans over orders, lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import arrays, numbers
from trustframe.operators import filters, rates
from trustframe.operators.reconcile import sum_same_unit as same_unit
from trustframe.operators.reconcile import weighted_sum
from trustframe.plans.registry import plan
from trustframe.session import load_table


def sql_progressive(x: str, brackets, floor_at: float = 0.0) -> str:
    terms, lower = ["0.0::DOUBLE"], float(floor_at)
    for cap, rate in brackets:
        if cap is not None and cap <= floor_at:
            continue
        top = x if cap is None else f"least({x}, {float(cap)}::DOUBLE)"
        terms.append(f"greatest({top} - {lower}::DOUBLE, 0.0::DOUBLE) * {float(rate)}::DOUBLE")
        lower = float(cap) if cap is not None else lower
    return "(" + " + ".join(terms) + ")"


def cents_sql(x: str) -> str:
    return f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"


def cents(x):
    return F.floor(x * 100 + 0.5).cast("bigint")


NZ, CA, AU = P.NZ_RATES, P.CA_RATES, P.AU_RATES
G = "o_totalprice"


def income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@plan("net_pay_nz", f"""
WITH t AS (SELECT o_orderkey, {G}, {sql_progressive(G, NZ['brackets'])} AS tax, least({G}, {NZ['levy']['cap']}.0::DOUBLE) * {NZ['levy']['rate']}::DOUBLE AS levy FROM orders)
SELECT o_orderkey, {cents_sql('tax')} AS tax_cents, {cents_sql('levy')} AS levy_cents, CAST(floor({G} - tax - levy + 0.5) AS BIGINT) AS net FROM t
""")
def net_pay_nz(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = rates.net_pay_nz(F.col(G), NZ)
    return income(spark, sf_dir).select(
        "o_orderkey", cents(pay["tax"]).alias("tax_cents"), cents(pay["levy"]).alias("levy_cents"), pay["net"].cast("bigint").alias("net")
    )


def sql_ca(province: str) -> str:
    pen, ins, fed, prov, on = CA["pension"], CA["insurance"], CA["federal"], CA["provinces"][province], CA["ontario"]
    tiers = " ".join(
        (f"ELSE least({float(cap)}::DOUBLE, {float(base)}::DOUBLE + (taxable - {float(off)}::DOUBLE) * {rate}::DOUBLE)" if to is None
         else f"WHEN taxable <= {to} THEN least({float(cap)}::DOUBLE, {float(base)}::DOUBLE + (taxable - {float(off)}::DOUBLE) * {rate}::DOUBLE)")
        for to, base, off, rate, cap in on["health_tiers"]
    )
    basic = f"greatest({sql_progressive('taxable', prov['brackets'])} - ({float(prov['personal'])}::DOUBLE + base + insurance) * {prov['brackets'][0][1]}::DOUBLE, 0.0::DOUBLE)"
    final = "basic"
    if province == "on":
        final = (
            f"greatest(basic + (greatest(basic - {float(on['surtax_lower'])}::DOUBLE, 0.0::DOUBLE) * {on['surtax_lower_rate']}::DOUBLE + "
            f"greatest(basic - {float(on['surtax_upper'])}::DOUBLE, 0.0::DOUBLE) * {on['surtax_upper_rate']}::DOUBLE) + "
            f"CASE WHEN taxable <= {on['health_zero_to']} THEN 0.0::DOUBLE {tiers} END - "
            f"least(basic, greatest({float(on['reduction'])}::DOUBLE - basic, 0.0::DOUBLE)), 0.0::DOUBLE)"
        )
    return f"""
    SELECT o_orderkey, '{province}' AS province, federal, {final} AS provincial, pension, insurance, {G} AS g FROM (
     SELECT *, {basic} AS basic, greatest({sql_progressive('taxable', fed['brackets'])} - ({float(fed['personal'])}::DOUBLE + base + insurance + least({G}, {float(fed['employment'])}::DOUBLE)) * {fed['credit_rate']}::DOUBLE, 0.0::DOUBLE) AS federal FROM (
      SELECT *, base + additional + second AS pension, greatest({G} - additional - second, 0.0::DOUBLE) AS taxable FROM (
       SELECT o_orderkey, {G}, least({G}, {float(ins['max'])}::DOUBLE) * {ins['rate']}::DOUBLE AS insurance,
        greatest(least({G}, {float(pen['ceiling'])}::DOUBLE) - {float(pen['exempt'])}::DOUBLE, 0.0::DOUBLE) * {pen['base']}::DOUBLE AS base,
        greatest(least({G}, {float(pen['ceiling'])}::DOUBLE) - {float(pen['exempt'])}::DOUBLE, 0.0::DOUBLE) * {pen['additional']}::DOUBLE AS additional,
        greatest(least({G}, {float(pen['second_max'])}::DOUBLE) - {float(pen['second_min'])}::DOUBLE, 0.0::DOUBLE) * {pen['second_rate']}::DOUBLE AS second FROM orders)))"""


@plan("net_pay_ca", "WITH t AS (" + " UNION ALL ".join(sql_ca(p) for p in ("on", "bc", "ab")) + f""")
SELECT o_orderkey, province, {cents_sql('federal')} AS federal_cents, {cents_sql('provincial')} AS provincial_cents, {cents_sql('pension')} AS pension_cents,
 {cents_sql('insurance')} AS insurance_cents, CAST(floor(g - (federal + provincial + pension + insurance) + 0.5) AS BIGINT) AS net FROM t""")
def net_pay_ca(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = rates.net_pay_ca(income(spark, sf_dir), G, CA)
    parts = [
        F.struct(
            F.lit(p).alias("province"), cents(F.col("federal")).alias("federal_cents"),
            cents(F.col(f"provincial_{p}")).alias("provincial_cents"), cents(F.col("pension")).alias("pension_cents"),
            cents(F.col("insurance")).alias("insurance_cents"), F.col(f"net_{p}").cast("bigint").alias("net"),
        )
        for p in ("on", "bc", "ab")
    ]
    return pay.select("o_orderkey", F.explode(F.array(*parts)).alias("p")).select("o_orderkey", "p.*")


OFF = AU["offset"]
OFFSET_SQL = (
    f"CASE WHEN {G} <= {OFF['full_to']} THEN {float(OFF['max'])}::DOUBLE WHEN {G} <= {OFF['taper1_to']} THEN {float(OFF['max'])}::DOUBLE - ({G} - {float(OFF['full_to'])}::DOUBLE) * {OFF['taper1_rate']}::DOUBLE "
    f"WHEN {G} <= {OFF['cut_out']} THEN {float(OFF['max']) - (OFF['taper1_to'] - OFF['full_to']) * OFF['taper1_rate']}::DOUBLE - ({G} - {float(OFF['taper1_to'])}::DOUBLE) * {OFF['taper2_rate']}::DOUBLE ELSE 0.0::DOUBLE END"
)


@plan("net_pay_au", f"""
WITH t AS (SELECT o_orderkey, {G} AS g, 'whm' AS mode, least({G}, {float(AU['holiday']['cap'])}::DOUBLE) * {AU['holiday']['rate']}::DOUBLE + {sql_progressive(G, AU['brackets'], AU['holiday']['cap'])} AS tax, 0.0::DOUBLE AS medicare FROM orders
UNION ALL SELECT o_orderkey, {G}, 'resident', greatest({sql_progressive(G, AU['brackets'])} - ({OFFSET_SQL}), 0.0::DOUBLE), {G} * {AU['medicare']}::DOUBLE FROM orders)
SELECT o_orderkey, mode, CAST(floor(tax + 0.5) AS BIGINT) AS tax, CAST(floor(medicare + 0.5) AS BIGINT) AS medicare,
 CAST(floor(g - tax - medicare + 0.5) AS BIGINT) AS net, CAST(floor(g * {AU['super']}::DOUBLE + 0.5) AS BIGINT) AS super FROM t
""")
def net_pay_au(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for mode in ("whm", "resident"):
        pay = rates.net_pay_au(F.col(G), mode, AU)
        parts.append(F.struct(F.lit(mode).alias("mode"), *[pay[k].cast("bigint").alias(k) for k in ("tax", "medicare", "net", "super")]))
    return income(spark, sf_dir).select("o_orderkey", F.explode(F.array(*parts)).alias("p")).select("o_orderkey", "p.*")


@plan("boundary_probes", f"""
WITH p AS (SELECT o_orderkey, 'just-below' AS probe, {G} - 1 AS v FROM orders UNION ALL SELECT o_orderkey, 'exact', {G} FROM orders UNION ALL SELECT o_orderkey, 'just-above', {G} + 1 FROM orders)
SELECT o_orderkey, probe, {cents_sql(sql_progressive('v', NZ['brackets']))} AS tax_cents, {cents_sql(sql_progressive('v', CA['federal']['brackets']))} AS federal_cents, false AS mismatch FROM p
""")
def boundary_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order total as a threshold: probes around it, closed form against the table-driven form."""
    rows = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("scope"))
    probes = rates.probe_points(rows, G)
    table = spark.createDataFrame(
        [(s, i, None if c is None else float(c), float(r)) for s in "FOP" for i, (c, r) in enumerate(NZ["brackets"])],
        "scope string, seq int, cap double, rate double",
    )
    both = rates.progressive_by_table(probes, "probe_value", table, "scope", out="by_table")
    tax = rates.progressive(F.col("probe_value"), NZ["brackets"])
    return both.select(
        "o_orderkey", "probe", cents(tax).alias("tax_cents"),
        cents(rates.progressive(F.col("probe_value"), CA["federal"]["brackets"])).alias("federal_cents"),
        rates.probe_mismatch(F.col("by_table"), tax).alias("mismatch"),
    )


@plan("semantic_probes", """
WITH p AS (SELECT p_partkey, p_type='ECONOMY' AS capped, CAST(p_size AS DOUBLE) AS lo, CAST(p_size + 10 AS DOUBLE) AS hi FROM part),
s AS (SELECT p_partkey, capped, 'just-below-min' AS probe, lo - 1 AS v, false AS expected, lo, hi FROM p WHERE NOT capped
UNION ALL SELECT p_partkey, capped, 'exact-min', lo, true, lo, hi FROM p WHERE NOT capped
UNION ALL SELECT p_partkey, capped, 'exact-max', hi, true, lo, hi FROM p WHERE NOT capped
UNION ALL SELECT p_partkey, capped, 'just-above-max', hi + 1, false, lo, hi FROM p WHERE NOT capped
UNION ALL SELECT p_partkey, capped, 'just-below', hi - 1, true, lo, hi FROM p WHERE capped
UNION ALL SELECT p_partkey, capped, 'exact', hi, true, lo, hi FROM p WHERE capped
UNION ALL SELECT p_partkey, capped, 'just-above', hi + 1, false, lo, hi FROM p WHERE capped)
SELECT p_partkey, probe, v AS probe_value, expected, CASE WHEN capped THEN v <= hi ELSE v >= lo AND v <= hi END AS actual FROM s
""")
def semantic_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared ranges of parts against the claim text they publish."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    kind = F.when(F.col("p_type") == "ECONOMY", F.lit("maximum")).otherwise(F.lit("inclusive-range"))
    low, high = F.col("p_size").cast("double"), (F.col("p_size") + 10).cast("double")
    rows = p.select(
        "p_partkey", kind.alias("kind"), low.alias("lo"), high.alias("hi"),
        numbers.text_transform("inclusive-range", F.concat_ws(" to ", "p_size", (F.col("p_size") + 10).cast("string"))).alias("claim"),
    )
    probes = rates.semantic_probes(rows, F.col("kind"), F.col("lo"), F.col("hi"), F.lit(1.0))
    claimed = arrays.boundary_values(F.col("claim"))
    lo, hi = claimed[0].cast("double"), claimed[1].cast("double")
    v = F.col("probe_value")
    actual = F.when(F.col("kind") == "maximum", v <= hi).otherwise(v.between(lo, hi))
    return probes.select("p_partkey", "probe", "probe_value", "expected", actual.alias("actual"))


@plan("bracket_rules", """
WITH b AS (SELECT o_custkey, o_orderkey AS seq, CASE WHEN o_orderstatus='P' THEN NULL ELSE o_totalprice - 200000 END AS cap, CASE WHEN o_orderpriority='5-LOW' THEN -0.1 ELSE 0.2 END AS rate FROM orders),
w AS (SELECT *, lag(cap) OVER (PARTITION BY o_custkey ORDER BY seq) AS prev, seq = max(seq) OVER (PARTITION BY o_custkey) AS is_last, seq = min(seq) OVER (PARTITION BY o_custkey) AS is_first, count(*) OVER (PARTITION BY o_custkey) AS n FROM b)
SELECT o_custkey, seq, 'TOO_FEW_BANDS' AS code FROM w WHERE is_first AND n < 2
UNION ALL SELECT o_custkey, seq, 'NEGATIVE_RATE' FROM w WHERE rate < 0
UNION ALL SELECT o_custkey, seq, 'LAST_NOT_OPEN' FROM w WHERE is_last AND cap IS NOT NULL
UNION ALL SELECT o_custkey, seq, 'OPEN_NOT_LAST' FROM w WHERE NOT is_last AND cap IS NULL
UNION ALL SELECT o_custkey, seq, 'CAP_NOT_POSITIVE' FROM w WHERE NOT is_last AND cap <= 0
UNION ALL SELECT o_custkey, seq, 'CAP_NOT_INCREASING' FROM w WHERE NOT is_last AND cap <= prev
""")
def bracket_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    b = o.select(
        "o_custkey", F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") - 200000).alias("cap"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(-0.1)).otherwise(F.lit(0.2)).alias("rate"),
    )
    return rates.bracket_problems(b, ["o_custkey"], F.floor(F.col("seq") / 4096))


@plan("contiguity_rules", """
WITH b AS (SELECT o_custkey, o_orderkey AS seq, CAST(floor(o_totalprice / 1000) AS BIGINT) AS lower, CASE WHEN o_orderstatus='P' THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) + 9 END AS upper FROM orders),
w AS (SELECT *, lag(upper) OVER (PARTITION BY o_custkey ORDER BY seq) AS prev, seq = max(seq) OVER (PARTITION BY o_custkey) AS is_last, seq = min(seq) OVER (PARTITION BY o_custkey) AS is_first FROM b)
SELECT o_custkey, seq, 'START_NOT_ZERO' AS code FROM w WHERE is_first AND lower <> 0
UNION ALL SELECT o_custkey, seq, 'GAP' FROM w WHERE NOT is_first AND lower IS DISTINCT FROM prev + 1
UNION ALL SELECT o_custkey, seq, 'LAST_NOT_OPEN' FROM w WHERE is_last AND upper IS NOT NULL
""")
def contiguity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    low = F.floor(F.col("o_totalprice") / 1000)
    b = o.select("o_custkey", F.col("o_orderkey").alias("seq"), low.alias("lower"), F.when(F.col("o_orderstatus") != "P", low + 9).alias("upper"))
    return rates.contiguity_problems(b, ["o_custkey"], F.floor(F.col("seq") / 4096))


@plan("taper_rules", """
WITH t AS (SELECT p_partkey, p_retailprice AS mx, p_size * 1000.0 AS f, p_size * 1000.0 + 5000 AS t1, 0.05 AS r1, p_retailprice - 250.0 + CASE WHEN p_type='PROMO' THEN 1 ELSE 0 END AS o2,
  CASE WHEN p_type='SMALL' THEN p_size * 1000.0 ELSE p_size * 1000.0 + 5000 + (p_retailprice - 250.0) * 100 END AS cut, 0.01 AS r2 FROM part)
SELECT p_partkey, 'THRESHOLD_ORDER' AS code FROM t WHERE NOT (f < t1 AND t1 < cut)
UNION ALL SELECT p_partkey, 'SECOND_OFFSET' FROM t WHERE abs(mx - r1 * (t1 - f) - o2) > 1e-9
UNION ALL SELECT p_partkey, 'CUT_OUT' FROM t WHERE abs(o2 - r2 * (cut - t1)) > 0.01
""")
def taper_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part")
    full = F.col("p_size") * 1000.0
    first = full + 5000
    left = F.col("p_retailprice") - 250.0
    second = left + F.when(F.col("p_type") == "PROMO", F.lit(1)).otherwise(F.lit(0))
    cut = F.when(F.col("p_type") == "SMALL", full).otherwise(first + left * 100)
    codes = rates.taper_problems(F.col("p_retailprice"), full, first, F.lit(0.05), second, cut, F.lit(0.01))
    return p.select("p_partkey", F.explode(codes).alias("code"))


@plan("bracket_text", """
WITH p AS (SELECT p_partkey, p_size AS a, p_size + 10 AS b FROM part)
SELECT p_partkey, a || '@0;' || b || '@0.30;above@0.45' AS text, CAST(3 AS INTEGER) AS bands, a || '-' || b AS range_text FROM p
""")
def bracket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"))

    def band(cap, rate):
        return F.struct(cap.cast("double").alias("cap"), F.lit(float(rate)).alias("rate"))

    rows = p.select("p_partkey", "a", F.array(band(F.col("a"), 0), band(F.col("a") + 10, 0.3), band(F.lit(None), 0.45)).alias("bands"))
    text = arrays.serialize_brackets(F.col("bands"), rate_text=arrays.rate_keeping_scale)
    return rows.select(
        "p_partkey", text.alias("text"), F.size(arrays.parse_brackets(text)).alias("bands"),
        arrays.join_range(F.array(F.col("a"), F.col("a") + 10)).alias("range_text"),
    )


@plan("points_score", """
SELECT l_orderkey, count(*) AS components, bool_and(l_returnflag <> 'R') AS units_agree,
 CASE WHEN bool_and(l_returnflag <> 'R') THEN sum(CAST(l_quantity AS BIGINT) * CASE WHEN l_linestatus='O' THEN 4 ELSE 1 END)::BIGINT END AS total FROM lineitem GROUP BY 1
""")
def points_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus", "l_returnflag")
    unit = F.when(F.col("l_returnflag") == "R", F.lit("points/ability")).otherwise(F.lit("points"))
    weight = F.when(F.col("l_linestatus") == "O", F.lit(4)).otherwise(F.lit(1))
    return weighted_sum(li, ["l_orderkey"], F.col("l_quantity").cast("bigint"), weight, unit, F.lit("points"))


@plan("sum_same_unit", """
SELECT l_suppkey, count(*) AS inputs, CASE WHEN min(l_returnflag)=max(l_returnflag) THEN min(l_returnflag) END AS unit,
 CASE WHEN min(l_returnflag)=max(l_returnflag) THEN sum(CAST(l_quantity AS BIGINT))::BIGINT END AS total, l_orderkey FROM lineitem GROUP BY l_suppkey, l_orderkey
""")
def sum_same_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    return same_unit(li, ["l_suppkey", "l_orderkey"], F.col("l_quantity").cast("bigint"), F.col("l_returnflag"))


CASH_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(round(c_acctbal * 100) AS BIGINT) AS start, -CAST(round(o_totalprice) AS BIGINT) AS lo,
  CASE WHEN o_orderpriority='1-URGENT' THEN -CAST(round(o_totalprice) AS BIGINT) - 5 ELSE CAST(round(o_totalprice) AS BIGINT) END AS hi FROM orders JOIN customer ON o_custkey=c_custkey),
w AS (SELECT *, start + sum(lo) OVER p AS cash_min, start + sum(hi) OVER p AS cash_max FROM r WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
"""


def cash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    price = F.round("o_totalprice").cast("bigint")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("start"),
        (-price).alias("lo"), F.when(F.col("o_orderpriority") == "1-URGENT", -price - 5).otherwise(price).alias("hi"),
    )
    return filters.cash_ranges(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.trunc("o_orderdate", "MM"), "start", "lo", "hi")


@plan("cash_plan", CASH_SQL + "SELECT o_orderkey, CAST(cash_min AS BIGINT) AS cash_min, CAST(cash_max AS BIGINT) AS cash_max FROM w")
def cash_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cash_rows(spark, sf_dir).select("o_orderkey", F.col("cash_min").cast("bigint").alias("cash_min"), F.col("cash_max").cast("bigint").alias("cash_max"))


@plan("plan_contract", CASH_SQL + """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, 'RANGE' AS code, 'd_min' AS field, count(*) AS n FROM w WHERE lo > hi GROUP BY 1
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'RUNNING_RANGE', 'cash_min', count(*) FROM w WHERE cash_min > cash_max GROUP BY 1
""")
def plan_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cash_rows(spark, sf_dir).select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ord"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("o_orderpriority").alias("visa"), F.lit("order").alias("act"), F.col("lo").cast("string").alias("cash"),
        F.col("lo").cast("double").alias("d_min"), F.col("hi").cast("double").alias("d_max"),
        F.col("cash_min").cast("double").alias("cash_min"), F.col("cash_max").cast("double").alias("cash_max"),
    )
    return filters.plan_problems(rows).groupBy("entity_id", "code", "field").agg(F.count(F.lit(1)).alias("n"))


@plan("outcome_contract", """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, o_orderstatus AS st, o_orderpriority AS pr, o_custkey % 4 AS n, o_custkey % 7 AS m FROM orders)
SELECT entity_id, 'PRIMARY' AS code FROM o WHERE st <> 'O'
UNION ALL SELECT entity_id, 'ALT' FROM o WHERE st='F' AND pr <> '5-LOW'
UNION ALL SELECT entity_id, 'WARNINGS' FROM o WHERE n < 2
UNION ALL SELECT entity_id, 'STAGES' FROM o WHERE n = 3
UNION ALL SELECT entity_id, 'MONTHS' FROM o WHERE n <> 3 AND m < 2
UNION ALL SELECT entity_id, 'MISSING_TEXT' FROM o WHERE st='P' AND pr NOT LIKE '%MEDIUM%'
UNION ALL SELECT entity_id, 'FORBIDDEN_TEXT' FROM o WHERE pr LIKE '%HIGH%'
UNION ALL SELECT entity_id, 'NUMERIC_TEXT' FROM o WHERE pr='4-NOT SPECIFIED'
""")
def outcome_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    st, pr, n = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey") % 4
    none = F.array().cast("array<string>")
    months = F.array((F.col("o_custkey") % 7 - 1).cast("double"), F.lit(3.0))
    rows = o.select(
        F.col("o_orderkey").alias("case_id"), st.alias("primary"), F.lit("O").alias("expected_primary"), pr.alias("alt"),
        F.when(st == "F", F.lit("5-LOW")).alias("expected_alt"), F.lit("plan").alias("name"), F.lit("12 months").alias("duration"),
        F.when(pr == "4-NOT SPECIFIED", F.lit("about NaN dollars")).otherwise(F.lit("about 10 dollars")).alias("cost"),
        F.lit("text").alias("summary"), F.when(n < 3, months).alias("stage_months"), n.alias("warnings"),
        F.lit(2).alias("min_warnings"), pr.alias("money_text"), F.when(st == "P", F.array(F.lit("MEDIUM"))).otherwise(none).alias("includes"),
        F.array(F.lit("HIGH")).alias("excludes"),
    )
    return filters.outcome_problems(rows).select("entity_id", "code")
