"""Evidence from documents: selectors, bound values, canonical documents, partitions of inputs, extractors, bracket tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustframe.functions import selectors, variants
from trustframe.operators import bindings as B
from trustframe.operators import entities as E
from trustframe.operators import extraction as X
from trustframe.operators import lineage as L
from trustframe.operators import pages as G
from trustframe.operators import rates, rules
from trustframe.plans.registry import plan
from trustframe.session import checkpoint_root, cut_lineage, load_table, spread
from trustframe.sources import readers


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run-time constants of every part: (page, size, document)."""
    p = spread(load_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit('{"rates":[{"id":"a","v":'), size, F.lit('},{"id":"b","v":'), key, F.lit('.50},{"v":0},{"id":"dup","v":1},{"id":"dup","v":2}],"span":"'), size, F.lit("-"),
        (F.col("p_size") + 10).cast("string"), F.lit('","list":['), size, F.lit(',5],"bands":[['), size, F.lit(',0.10],["Infinity",0.205]],"label":"none"}'))
    return p.select(key.alias("page"), "p_size", F.try_parse_json(text).alias("document"))


@plan("selector_values", """
SELECT CAST(p_partkey AS VARCHAR) AS page, 'rates[id=a].v' AS path, CAST(p_size AS VARCHAR) AS value_text, NULL AS problem, NULL AS hits FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rates[1].v', p_partkey || '.5', NULL, NULL FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rates[id="dup"].v', NULL, 'several-matches', 2 FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rates[id=zz].v', NULL, 'no-match', 0 FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rates[9].v', NULL, 'no-index', NULL FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'span[v=1]', NULL, 'not-array', NULL FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'rates[', NULL, 'malformed-path', NULL FROM part
UNION ALL SELECT '-' || p_partkey, 'span', NULL, 'no-document', NULL FROM part WHERE p_partkey % 10 = 0
""")
def selector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_documents(spark, sf_dir)
    paths = ["rates[id=a].v", "rates[1].v", 'rates[id="dup"].v', "rates[id=zz].v", "rates[9].v", "span[v=1]", "rates["]
    wanted = docs.select("page", F.explode(F.array(*map(F.lit, paths))).alias("path"))
    lost = docs.filter("cast(page as bigint) % 10 = 0").select(F.concat(F.lit("-"), "page").alias("page"), F.lit("span").alias("path"))
    out = selectors.selector_values(wanted.unionByName(lost), docs, "page", "path", "document")
    return out.select("page", "path", "value_text", "problem", F.col("hits").cast("int").alias("hits"))


def part_bindings(docs: DataFrame) -> DataFrame:
    """Five bindings a part: a number, a range, a sum, brackets and a text without a number."""
    kinds = [
        ("rates[id=b].v", "multiply", "rate", "100"), ("span", "identity", "age", None), ("list", "sum", "duration", None),
        ("label", "identity", "insurance", None), ("rates[id=dup].v", "identity", "rate", None),
    ]
    own = F.array(*[F.struct(F.lit(path).alias("runtime_path"), F.lit(op).alias("op"), F.lit(kind).alias("boundary_kind"), F.lit(factor).cast("decimal(38,18)").alias("factor"))
                    for path, op, kind, factor in kinds])
    rows = docs.select("page", "p_size", F.explode(own).alias("x")).select(
        F.concat_ws(":", "page", "x.runtime_path").alias("claim_id"), F.lit("en").alias("edition"), "page", F.lit("NZD").alias("unit"), "p_size", "x.*")
    odd = F.col("p_size") % 10 == 0
    return rows.withColumn("boundary_kind", F.when(odd & (F.col("runtime_path") == "span"), F.lit("colour")).otherwise(F.col("boundary_kind"))).drop("p_size")


@plan("boundary_sets", """
SELECT p_partkey || ':rates[id=b].v' AS claim_id, 'rate' AS kind, CAST(p_partkey * 100 + 50 AS VARCHAR) AS bounds FROM part
UNION ALL SELECT p_partkey || ':span', 'age', p_size || ',' || (p_size + 10) FROM part WHERE p_size % 10 <> 0
UNION ALL SELECT p_partkey || ':list', 'duration', CAST(p_size + 5 AS VARCHAR) FROM part
UNION ALL SELECT p_partkey || ':span', 'INVALID_KIND', NULL FROM part WHERE p_size % 10 = 0
UNION ALL SELECT p_partkey || ':label', 'NO_BOUNDARY', NULL FROM part
UNION ALL SELECT p_partkey || ':rates[id=dup].v', 'NO_BOUNDARY', NULL FROM part
UNION ALL SELECT p_partkey || ':rates[id=dup].v', 'several-matches', NULL FROM part
""")
def boundary_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the JSON constants to the boundaries of every bound value, with all that is wrong."""
    docs = part_documents(spark, sf_dir)
    bound = cut_lineage(B.bound_values(part_bindings(docs), docs))
    none = F.lit(None).cast("string").alias("bounds")
    sets = B.boundary_sets(bound).select("claim_id", "kind", F.array_join("values", ",").alias("bounds"))
    issues = B.boundary_issues(bound).select("claim_id", F.col("code").alias("kind"), none)
    paths = bound.filter("path_problem is not null").select("claim_id", F.col("path_problem").alias("kind"), none)
    return sets.unionByName(issues).unionByName(paths)


@plan("bindings_by_selector", """
SELECT p_partkey || ':list' AS claim_id, 'VALUE_MISMATCH' AS code FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey || ':bands', 'VALUE_MISMATCH' FROM part WHERE p_size % 11 = 0
UNION ALL SELECT p_partkey || ':rates[id=dup].v', 'TRANSFORM_FAILED' FROM part UNION ALL SELECT p_partkey || ':rates[id=dup].v', 'TYPE_MISMATCH' FROM part
""")
def bindings_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against the values that their selectors find in the JSON constants."""
    docs = part_documents(spark, sf_dir)
    size = F.col("p_size")
    claimed = F.array(
        F.struct(F.lit("list").alias("path"), F.lit("sum").alias("op"), F.lit("array").alias("type"), (size + F.when(size % 7 == 0, 6).otherwise(5)).cast("string").alias("value")),
        F.struct(F.lit("bands").alias("path"), F.lit("serializeBrackets").alias("op"), F.lit("array").alias("type"), F.concat((size + F.when(size % 11 == 0, 1).otherwise(0)).cast("string"), F.lit("@0.1;above@0.205")).alias("value")),
        F.struct(F.lit("rates[id=dup].v").alias("path"), F.lit("identity").alias("op"), F.lit("number").alias("type"), F.lit("1").alias("value")))
    rows = docs.select("page", F.explode(claimed).alias("x")).select("page", "x.*", F.concat_ws(":", "page", "x.path").alias("claim_id"))
    rows = cut_lineage(rows)
    none = F.lit(None).cast("string")
    bindings = rows.select(
        F.xxhash64("claim_id").alias("ord"), "claim_id", F.lit("en").alias("edition"), "page", F.col("path").alias("runtime_path"), "op", F.lit("NZD").alias("unit"),
        F.lit(None).cast("decimal(38,18)").alias("factor"), none.alias("runtime_url"), none.alias("runtime_date"))
    claims = rows.select("claim_id", F.lit("NZ").alias("country"), F.lit("en").alias("locale"), F.array("page").alias("pages"), F.lit("NZD").alias("unit"),
                         F.col("type").alias("value_type"), F.col("value").alias("value_text"), F.lit("https://a.example/").alias("source_url"), F.lit("2026-01-01").alias("verified_at"))
    editions = spark.createDataFrame([("en", "", "NZ", "en")], "edition string, page string, country string, locale string")
    bound = cut_lineage(B.bound_values(bindings, docs))
    return B.binding_issues(bound, claims, editions, claims.select("claim_id")).filter("code <> 'EDITION_PAGE'").select(F.col("entity_id").alias("claim_id"), "code")


@plan("canonical_documents", """
SELECT event_id, '{"a":{"c":"' || event_type || '","d":[[],{},null]},"z":[{"a":1.5,"b":' || CAST(json_extract(props,'$.k') AS BIGINT) || '},[true,"x"]]}' AS canonical FROM events
""")
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with unordered keys, arrays inside objects and numbers in several spellings."""
    e = load_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"z":[{"b":'), k, F.lit('.0,"a":1.50},[true,"x"]],"a":{"d":[[],{},null],"c":"'), "event_type", F.lit('"}}'))
    return variants.canonical_documents(e.select("event_id", F.try_parse_json(doc).alias("doc")), "doc", ["event_id"])


@plan("nested_differences", """
SELECT event_id, '/b/0/x' AS pointer, CAST(event_id AS VARCHAR) AS expected_value, CASE WHEN event_type='error' THEN CAST(event_id + 1 AS VARCHAR) END AS actual_value FROM events WHERE event_type IN ('error', 'signup')
UNION ALL SELECT event_id, '/c', 'true', '1' FROM events WHERE event_type='click'
""")
def nested_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results against expected ones: a number off by one, one that is lacking, and true in place of 1."""
    e = spread(load_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    wanted = F.concat(F.lit('{"b":[{"x":'), n, F.lit("}],\"c\":"), F.when(kind == "click", "true").otherwise("1"), F.lit("}"))
    got = F.concat(F.lit('{"b":[{"x":'), F.when(kind == "error", (F.col("event_id") + 1).cast("string")).when(kind == "signup", F.lit('0},{"y":0')).otherwise(F.concat(n, F.lit(".0000000000001"))), F.lit('}],"c":1,"more":[1]}'))
    got = F.when(kind == "signup", F.replace(got, F.lit('"x":0'), F.lit('"w":0'))).otherwise(got)
    leaves = lambda text: variants.explode_leaves(e.select("event_id", F.try_parse_json(text).alias("doc")), "doc", ["event_id"], 6)
    return variants.nested_differences(leaves(got), leaves(wanted), ["event_id"], 1e-12)


@plan("input_partition", """
SELECT 'CARDINALITY' AS code, CAST(p_partkey AS VARCHAR) AS target, '/cap' AS path, NULL AS attestation, '0' AS actual, '1' AS expected FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'CARDINALITY', CAST(p_partkey AS VARCHAR), '/rates/1', NULL, '2', '1' FROM part WHERE p_partkey % 11 = 0
UNION ALL SELECT 'MISMATCH', CAST(p_partkey AS VARCHAR), '/cap', 'B' || p_partkey, CAST(p_size + 1 AS VARCHAR), CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 <> 0
UNION ALL SELECT 'UNIT', CAST(p_partkey AS VARCHAR), '/cap', 'B' || p_partkey, 'AUD', 'NZD' FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 7 <> 0
UNION ALL SELECT 'ORPHAN', CAST(p_partkey AS VARCHAR), '/zzz', 'A' || p_partkey, '0', 'a reviewed leaf' FROM part WHERE p_partkey % 17 = 0
UNION ALL SELECT 'MISMATCH', CAST(p_partkey AS VARCHAR), '/rates', 'A' || p_partkey, '3', '2' FROM part WHERE p_partkey % 23 = 0
UNION ALL SELECT 'UNMAPPED', CAST(p_partkey AS VARCHAR), NULL, 'C' || p_partkey, '0', '1' FROM part WHERE p_partkey % 19 = 0
""")
def input_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculator's inputs per part: leaves owned by none or twice, other values, units and numbers of leaves, and lost mappings."""
    p = spread(load_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    doc = F.concat(F.lit('{"rates":['), key, F.lit(',7],"cap":'), size, F.lit("}"))
    reviewed = variants.explode_leaves(p.select(key.alias("target"), F.try_parse_json(doc).alias("d")), "d", ["target"], 3).withColumn("unit", F.lit("NZD"))
    a = p.select(F.concat(F.lit("A"), key).alias("attestation"), F.lit("NZD").alias("unit"),
                 F.try_parse_json(F.concat(F.lit('{"x":{"r":['), key, F.lit(",7"), F.when(k % 23 == 0, ",8").otherwise(""), F.lit("]}}"))).alias("d"))
    b = p.select(F.concat(F.lit("B"), key).alias("attestation"), F.when(k % 13 == 0, "AUD").alias("unit"),
                 F.try_parse_json(F.concat(F.lit('{"c":'), (F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("}"))).alias("d"))
    source = variants.explode_leaves(a.unionByName(b), "d", ["attestation", "unit"], 4)

    def mapping(when: Column, who: str, path: str, expected: str) -> Column:
        return F.when(when, F.struct(F.concat(F.lit(who), key).alias("attestation"), F.lit(path).alias("reviewed_path"), F.lit(expected).alias("expected_path")))

    own = F.array_compact(F.array(
        mapping(F.lit(True), "A", "/rates", "/x/r"), mapping(k % 7 != 0, "B", "/cap", "/c"), mapping(k % 11 == 0, "B", "/rates/1", "/c"), mapping(k % 17 == 0, "A", "/zzz", "/x")))
    mappings = p.select(key.alias("target"), F.explode(own).alias("m")).select("target", "m.*")
    allowed = p.filter(k % 19 == 0).select(key.alias("target"), F.concat(F.lit("C"), key).alias("attestation"))
    return L.input_partition(reviewed, source, mappings, allowed)


def bracket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of a page per supplier: two tables with a note between them; every fifth page breaks a rule."""
    s = load_table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    row = lambda label, rate: F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(rate).alias("rate"))
    second = F.when(k % 5 == 1, "18,203 – 45,000").when(k % 5 == 2, "18,200 – 45,000").otherwise("18,201 – 45,000")
    last = F.when(k % 5 == 3, "45,001 to 90,000").otherwise("Over 45,000")
    first = F.when(k % 5 == 4, "1 to 100").otherwise("0 to 100")
    rows = F.array(row("Taxable income", "Rate"), row("$0 - $18,200", "0%"), row(second, "15.50%"), row(F.when(last == "Over 45,000", "45,001 and above").otherwise(last), "30 %"),
                   row("Rates from July", "5%"), row(first, "1%"), row("101 and more", "2%"))
    return s.select(k.alias("page"), F.posexplode(rows).alias("row_no", "r")).select("page", "row_no", "r.label", "r.rate")


@plan("labelled_brackets", """
SELECT s_suppkey AS page, 1 AS table_no, 2 AS seq, 'GAP' AS code FROM supplier WHERE s_suppkey % 5 = 1 UNION ALL SELECT s_suppkey, 1, 2, 'OVERLAP' FROM supplier WHERE s_suppkey % 5 = 2
UNION ALL SELECT s_suppkey, 1, 3, 'LAST_NOT_OPEN' FROM supplier WHERE s_suppkey % 5 = 3 UNION ALL SELECT s_suppkey, 2, 1, 'START_NOT_ZERO' FROM supplier WHERE s_suppkey % 5 = 4
""")
def labelled_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.bracket_table_problems(rates.labelled_brackets(bracket_rows(spark, sf_dir)))


@plan("bracket_tables", """
SELECT s_suppkey AS page, 1 AS table_no, '18200@0;45000@0.1550;' || CASE WHEN s_suppkey % 5 = 3 THEN '90000' ELSE 'above' END || '@0.30' AS brackets FROM supplier
UNION ALL SELECT s_suppkey, 2, '100@0.01;above@0.02' FROM supplier
""")
def bracket_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.serialized_tables(rates.labelled_brackets(bracket_rows(spark, sf_dir)))


@plan("claim_constants", """
SELECT p_partkey AS claim_id, 'bands' AS assertion, CASE WHEN p_partkey % 3 = 0 THEN 'changed' ELSE 'match' END AS status FROM part
UNION ALL SELECT p_partkey, 'rate', CASE WHEN p_partkey % 4 = 0 THEN 'changed' ELSE 'match' END FROM part UNION ALL SELECT p_partkey, 'cap', CASE WHEN p_size = 5 THEN 'match' ELSE 'changed' END FROM part
UNION ALL SELECT p_partkey, 'other', 'unasserted' FROM part
""")
def claim_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    said = F.array(
        F.struct(F.lit("bands").alias("assertion"), F.when(k % 3 == 0, "100@0.105;200@0.3").otherwise("100@0.105;above@0.3").alias("value_text")),
        F.struct(F.lit("rate").alias("assertion"), F.when(k % 4 == 0, "2.1").otherwise("2").alias("value_text")),
        F.struct(F.lit("cap").alias("assertion"), F.col("p_size").cast("string").alias("value_text")), F.struct(F.lit("other").alias("assertion"), F.lit("1").alias("value_text")))
    claims = p.select(k.alias("claim_id"), F.explode(said).alias("x")).select("claim_id", "x.*")
    reviewed = spark.createDataFrame(
        [("bands", None, [(100.0, 0.105), (None, 0.3)], False), ("rate", 0.02, None, True), ("cap", 5.0, None, False)],
        "assertion string, constant double, brackets array<struct<cap:double,rate:double>>, percent boolean")
    return rates.claims_against_constants(claims, reviewed)


@plan("attestation_audit", """
WITH a AS (SELECT p_partkey AS k, p_size FROM part)
SELECT 'attestations' AS metric, count(*) AS n, NULL AS code FROM a UNION ALL SELECT 'claims', count(DISTINCT c), NULL FROM (SELECT k // 3 AS c FROM a UNION ALL SELECT k // 5 FROM a WHERE k % 2 = 0)
UNION ALL SELECT 'leaves', CAST(sum(p_size) AS BIGINT), 'DECLARED' FROM a UNION ALL SELECT 'live', count(*), 'PARTITION' FROM a
UNION ALL SELECT 'extract', count(*), NULL FROM a WHERE k % 3 = 0 UNION ALL SELECT 'fixture-only', count(*), NULL FROM a WHERE k % 3 = 1
""")
def attestation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the attestations; every third has a mode that is neither, and one declared count is off."""
    k = F.col("p_partkey")
    a = load_table(spark, sf_dir, "part").select(
        k.alias("attestation"), F.when(k % 3 == 0, "extract").when(k % 3 == 1, "fixture-only").otherwise("manual").alias("mode"),
        F.when(k % 2 == 0, F.array(F.floor(k / 3), F.floor(k / 5))).otherwise(F.array(F.floor(k / 3))).alias("claims"), F.col("p_size").alias("leaf_count"))
    counted = L.attestation_audit(a).select("metric", F.when(F.col("metric") == "leaves", F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return L.attestation_audit(a, counted)


def supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page, a CSV, an XML and a JSON document per supplier."""
    s = spread(load_table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    key = F.col("s_suppkey").cast("string")
    page = F.concat(
        F.lit("<html><body><h2>Fees</h2><dl><dt>Fee</dt><dd>"), key, F.lit("</dd></dl><h3>Wait</h3><p>about "), key, F.lit(" weeks</p><p hidden>about 1 week</p>"
              "<h2>From 1 January 2026</h2><table><tr><th>Item</th><th>Amount</th></tr><tr><td>cap</td><td>"), key, F.lit("</td></tr><tr><td>other, more</td><td>9</td></tr></table></body></html>"))
    csv = F.concat(F.lit('id,"amount, total"\n'), key, F.lit(',"1,5"\r\nx,2\nx,3\n'))
    xml = F.concat(F.lit('<list><quota id="a"><n>'), key, F.lit('</n></quota><quota id="b"><n>2</n></quota></list>'))
    record = F.concat(F.lit('{"rows":[{"id":1,"v":'), key, F.lit(',"a/b":[null]}]}'))
    bodies = F.create_map(F.lit("page"), page, F.lit("csv"), csv, F.lit("xml"), xml, F.lit("json"), record)
    return s.select("s_suppkey", F.explode(bodies).alias("kind", "body")).select("s_suppkey", F.concat_ws("-", "kind", key).alias("document"), "kind", "body")


_SPECS = [
    ("definition", "page", "html-definition", {"section": "Fees", "label": "Fee", "unit": "NZD", "value_type": "number"}),
    ("labelled", "page", "html-labelled-values", {"outer": "Fees", "label": "Wait", "unit": "weeks"}),
    ("anchor", "page", "html-section-text", {"heading": "Wait", "anchor": "about 7 weeks"}),
    ("record", "page", "html-table-record", {"section": "From 1 January 2026", "headers": "Item|Amount", "row": "cap", "column": "Amount", "unit": "NZD", "value_type": "number"}),
    ("column", "page", "html-table", {"headers": "Item|Amount", "column": "Amount"}),
    ("cell", "csv", "csv-cell", {"key_column": "id", "column": "amount, total", "unit": "AUD"}),
    ("twice", "csv", "csv-cell", {"key_column": "id", "key": "x", "column": "amount, total"}),
    ("quota", "xml", "xml-selector", {"selector": "quota[_id=b].n", "value_type": "number", "unit": "places"}),
    ("pointer", "json", "json-pointer", {"pointer": "/rows/0/v"}), ("null", "json", "json-pointer", {"pointer": "/rows/0/a~1b/0"}),
    ("absent", "json", "json-pointer", {"pointer": "/rows/1"}), ("picked", "json", "json-selector", {"selector": "rows[id=1].v", "unit": "NZD"}),
    ("text", "json", "json-selector", {"selector": "rows", "value_type": "number"}),
    ("odd", "json", "no-such-mode", {}), ("lost", "none", "json-pointer", {"pointer": "/"}),
]


def supplier_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut_lineage(supplier_documents(spark, sf_dir))
    declared = F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.from_json(F.lit(json.dumps(params)), "map<string,string>").alias("params"))
        for name, kind, mode, params in _SPECS])
    rows = load_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.explode(declared).alias("x")).select("key", "x.*")
    params = F.when(F.col("name") == "cell", F.map_concat("params", F.create_map(F.lit("key"), F.col("key")))).otherwise(F.col("params"))
    rows = rows.select(F.concat_ws("-", "name", "key").alias("spec_id"), F.concat_ws("-", "kind", "key").alias("document"), "mode", params.alias("params"))
    return X.extract_values(rows, docs.select("document", "body"))


@plan("extract_values", """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier)
SELECT 'definition-' || k AS spec_id, 'NZD' AS unit, k AS value, 'number' AS value_type, 1 AS hits, NULL AS problem FROM s
UNION ALL SELECT 'labelled-' || k, 'weeks', 'about ' || k || ' weeks', 'string', 1, NULL FROM s
UNION ALL SELECT 'anchor-' || k, NULL, CASE WHEN k='7' THEN 'about 7 weeks' END, CASE WHEN k='7' THEN 'string' END, CASE WHEN k='7' THEN 1 ELSE 0 END, CASE WHEN k<>'7' THEN 'NOT_ONE' END FROM s
UNION ALL SELECT 'record-' || k, 'NZD', k, 'number', 1, NULL FROM s UNION ALL SELECT 'column-' || k, NULL, '["' || k || '","9"]', 'array', 1, NULL FROM s
UNION ALL SELECT 'cell-' || k, 'AUD', '1,5', 'string', 1, NULL FROM s UNION ALL SELECT 'twice-' || k, NULL, NULL, NULL, 2, 'NOT_ONE' FROM s
UNION ALL SELECT 'quota-' || k, 'places', '2', 'number', 1, NULL FROM s UNION ALL SELECT 'pointer-' || k, NULL, k, 'number', 1, NULL FROM s
UNION ALL SELECT 'null-' || k, NULL, NULL, 'null', 1, NULL FROM s UNION ALL SELECT 'absent-' || k, NULL, NULL, NULL, 0, 'NOT_ONE' FROM s
UNION ALL SELECT 'picked-' || k, 'NZD', k, 'number', 1, NULL FROM s UNION ALL SELECT 'text-' || k, NULL, NULL, NULL, 1, 'NOT_A_NUMBER' FROM s
UNION ALL SELECT 'odd-' || k, NULL, NULL, NULL, 0, 'UNKNOWN_MODE' FROM s UNION ALL SELECT 'lost-' || k, NULL, NULL, NULL, 0, 'NO_DOCUMENT' FROM s
""")
def extract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of extractor over the documents of all suppliers."""
    return supplier_values(spark, sf_dir).select("spec_id", "unit", "value", "value_type", F.col("hits").cast("int").alias("hits"), "problem")


@plan("extraction_status", """
SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'changed' ELSE 'match' END AS status FROM supplier
""")
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every supplier's page against what is expected; every fourth expectation has another unit."""
    got = supplier_values(spark, sf_dir).filter("startswith(spec_id, 'record-')").withColumn("key", F.substr("spec_id", F.lit(8)))
    key = F.col("s_suppkey").cast("string")
    wanted = load_table(spark, sf_dir, "supplier").select(
        key.alias("key"), F.lit("number").alias("value_type"), F.when(F.col("s_suppkey") % 4 == 0, "AUD").otherwise("NZD").alias("unit"), key.alias("value_text"))
    return G.extraction_status(got.select("key", "value_type", "unit", F.col("value").alias("value_text")), wanted, ["key"])


def _written(df: DataFrame, column: Column, name: str) -> str:
    """The bodies as files of their own."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.select(column.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


@plan("keyed_xml", """
SELECT n_nationkey = 3 AS refused, CAST(CASE WHEN n_nationkey = 4 THEN 2 ELSE 1 END AS BIGINT) AS matches, CASE WHEN n_nationkey NOT IN (3, 4) THEN n_name END AS value FROM nation
""")
def keyed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML file per nation: one has a document type, one the key twice."""
    n = load_table(spark, sf_dir, "nation")
    row = F.concat(F.lit('<row id="x"><n> '), "n_name", F.lit(" </n></row>"))
    body = F.concat(F.when(F.col("n_nationkey") == 3, '<!DOCTYPE rows>').otherwise(""), F.lit('<rows><row id="y"><n>no</n></row>'), row, F.when(F.col("n_nationkey") == 4, row).otherwise(""), F.lit("</rows>"))
    return readers.read_keyed_xml(spark, _written(n, body, "xml"), "row", {"id": "x"}, "n").select("refused", "matches", "value")


@plan("page_files", "SELECT n_name AS title, CAST(1 AS BIGINT) AS pages FROM nation")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page file per nation, read back as text; none is unreadable, so no issue row appears."""
    n = load_table(spark, sf_dir, "nation")
    pages, issues = readers.read_pages(spark, _written(n, F.concat(F.lit("<title>"), "n_name", F.lit("</title>")), "html"))
    titles = pages.select(F.regexp_extract("html", "<title>(.*)</title>", 1).alias("title")).unionByName(issues.select(F.col("code").alias("title")))
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("pages"))


@plan("directory_migration", """
SELECT c_custkey, CASE WHEN c_nationkey < 12 AND c_acctbal < 0 THEN 'town' WHEN c_acctbal < 0 THEN 'exact' ELSE 'region' END AS precision,
 CASE WHEN c_nationkey >= 12 AND c_custkey % 3 = 0 THEN 'NSW' WHEN c_custkey % 3 = 0 THEN '' ELSE 'own' END AS region FROM customer
""")
def directory_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that were geocoded lose their exactness, and lacking regions become the state."""
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = c.select(
        "c_custkey", F.when(F.col("c_nationkey") < 12, "NZ").otherwise("AU").alias("country"), F.lit("NSW").alias("state"),
        F.when(F.col("c_acctbal") < 0, "exact").otherwise("region").alias("precision"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("own").alias("region"))
    return E.default_regions(E.downgrade_coordinates(rows)).select("c_custkey", "precision", "region")


@plan("constant_rules", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR p_size >= 40")
def constant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that are not the sum of their parts, or thresholds out of order."""
    p = load_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rate = F.when(F.col("p_partkey") % 3 == 0, F.lit(0.31)).otherwise(F.lit(0.3))
    return p.filter(rules.constants_inconsistent(rate, F.lit(0.1), F.lit(0.2), F.col("p_size"), F.lit(40))).select("p_partkey")
