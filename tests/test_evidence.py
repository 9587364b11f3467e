"""Selectors, canonical documents, leaf partitions, extractors, bracket tables, the audit, and levels of dependency graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trustframe.functions import selectors, variants
from trustframe.operators import bindings, extraction, lineage, rates
from trustframe.streaming import trend


def variant(df, text="j"):
    return df.withColumn("v", F.try_parse_json(text))


@pytest.mark.parametrize("path, want", [
    ("a.b[0].c", ("number", "1", None, None)), ("a.b[c=1].d", ("string", "x", None, None)), ("a.b[ d = 'y' ].c", ("boolean", "true", None, None)),
    ("a.b[c=true].d", ("string", "y", None, None)), ("a.b[e=null].c", ("number", "7", None, None)), ("a.b", ("array", "text", None, None)),
    ("a.n", ("null", None, None, None)), ("a.b[d=z].c", (None, None, "several-matches", 2)), ("a.b[d=q].c", (None, None, "no-match", 0)),
    ("a.b[4]", (None, None, "no-index", None)), ("a[c=1]", (None, None, "not-array", None)), ("a.q.r", (None, None, "no-property", None)),
    ("a.b[x]", (None, None, "malformed-path", None)), ("a..b", (None, None, "malformed-path", None)), ("a.b[0", (None, None, "malformed-path", None)),
    ("[0]", (None, None, "malformed-path", None)), ("a.b[d=]", (None, None, "malformed-path", None)), (" a.n ", ("null", None, None, None)),
])
def test_selector_paths(spark, path, want):
    doc = {"a": {"b": [{"c": 1, "d": "x"}, {"c": True, "d": "y"}, {"d": "z"}, {"d": "z", "e": None, "c": 7}], "n": None}}
    df = variant(spark.createDataFrame([(json.dumps(doc), path)], "j string, p string"))
    r = df.select(selectors.select_value(F.col("v"), F.col("p")).alias("r")).select(
        variants.json_type(F.col("r.value")), variants.scalar_text(F.col("r.value")), "r.problem", "r.hits").first()
    got = tuple(r)
    if want[1] == "text":
        assert got[0] == "array" and got[2] is None
    elif got[2] is None:
        assert got[:3] == want[:3]
    else:
        assert (None, None, *got[2:]) == want


def test_selectors_of_documents_in_demand_and_without_one(spark):
    docs = variant(spark.createDataFrame([(1, '{"a":1}'), (2, "not json")], "id int, j string"))
    asked = spark.createDataFrame([(1, f"a{'' if i == 0 else i}") for i in range(200)] * 2 + [(2, "a"), (3, "a")], "id int, p string")
    rows = selectors.selector_values(asked, docs, "id", "p", "v").collect()
    assert len(rows) == 202
    by = {(r.id, r.p): (r.value_text, r.problem) for r in rows}
    assert by[1, "a"] == ("1", None) and by[1, "a7"] == (None, "no-property") and by[3, "a"] == (None, "no-document") and by[2, "a"] == (None, "no-property")


def random_value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return [random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    if kind == 6:
        return {rnd.choice(["k", "a/b", "0", "ü", "q\"", "i0", "~"]) + str(rnd.randrange(3)): random_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [None, True, rnd.randrange(-5, 99), "text\n\"" + rnd.choice("ab\u0001\u0002"), rnd.randrange(99) / 4][kind]


def test_canonical_documents_of_random_values(spark):
    rnd = random.Random(11)
    docs = [random_value(rnd) for _ in range(120)] + [{"a": [[], {}], "b": {"c": [1.50, {"d": 2}]}}, [], {}, 1.0, "x", None]

    def shuffled(v):
        if isinstance(v, dict):
            keys = list(v)
            rnd.shuffle(keys)
            return {k: shuffled(v[k]) for k in keys}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v == int(v) else v

    rows = [(i, json.dumps(shuffled(d))) for i, d in enumerate(docs)]
    made = variants.canonical_documents(variant(spark.createDataFrame(rows, "id int, j string")), "v", ["id"]).collect()
    got = {r.id: r.canonical for r in made}
    for i, d in enumerate(docs):
        assert json.loads(got[i]) == plain(d), (d, got[i])
        assert got[i] == json.dumps(plain(d), sort_keys=True, separators=(",", ":"), ensure_ascii=False), got[i]


def test_canonical_documents_deeper_than_allowed(spark):
    df = variant(spark.createDataFrame([(1, '{"a":[[1]]}'), (2, '{"a":[1]}'), (3, None)], "id int, j string"))
    assert {r.id: r.canonical for r in variants.canonical_documents(df, "v", ["id"], 2).collect()}[1] is None


def test_leaves_equal_a_walk(spark):
    rnd = random.Random(4)
    docs = [random_value(rnd) for _ in range(80)]

    def walk(v, path=""):
        items = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        if not items:
            yield path or "/"
        for k, x in items:
            yield from walk(x, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")

    df = variant(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string"))
    got = sorted((r.id, r.pointer) for r in variants.explode_leaves(df, "v", ["id"], 6).collect())
    assert got == sorted((i, p) for i, d in enumerate(docs) for p in walk(d))


def test_nested_differences(spark):
    leaves = lambda j: variants.explode_leaves(variant(spark.createDataFrame([(1, j)], "id int, j string")), "v", ["id"], 4)
    got = variants.nested_differences(leaves('{"a":1.004,"b":[2,"x"],"c":true,"z":9}'), leaves('{"a":1,"b":[2.2,"x"],"c":1,"d":null}'), ["id"], 0.01)
    assert {(r.pointer, r.expected_value, r.actual_value) for r in got.collect()} == {("/b/0", "2.2", "2"), ("/c", "1", "true"), ("/d", None, None)}


def test_nested_differences_broadcast_no_leaves(spark):
    """A short table may have any number of leaves: its estimate is no reason to send them all to the driver."""
    leaves = lambda j: variants.explode_leaves(variant(spark.createDataFrame([(1, j)], "id int, j string")), "v", ["id"], 4)
    plan = variants.nested_differences(leaves('{"a":1}'), leaves('{"a":2}'), ["id"], 0.01)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_interval_cover_equals_prefixes(spark):
    rnd = random.Random(8)
    names = ["a", "b", "a0", "10", "9", "z"]
    leaves = sorted({(t, "/" + "/".join(rnd.choice(names) for _ in range(rnd.randrange(1, 5)))) for t in "xy" for _ in range(60)} | {("w", "/")})
    leaves = [(t, p) for t, p in leaves if not any(q != p and q.startswith(p + "/") for u, q in leaves if u == t)]
    paths = [(t, p, i + 1) for i, (t, p) in enumerate([(rnd.choice("xy"), rnd.choice(["/", "/a", "/a/b", "/10", "/zz", "/b", rnd.choice(leaves)[1]])) for _ in range(40)] + [("w", "/")])]
    a = spark.createDataFrame(leaves, "t string, p string")
    b = spark.createDataFrame(paths, "t string, q string, tag long")
    at, sized = lineage.interval_cover(a, b, "t", "p", "q", "tag")
    under = lambda p, q: q == "/" or p == q or p.startswith(q + "/")
    for r in at.collect():
        own = [g for t, q, g in paths if t == r.t and under(r.p, q)]
        assert r.owners == len(own) and r.owner == (own[0] if len(own) == 1 else None)
    assert {r.tag: r.leaf_count for r in sized.collect()} == {g: sum(u == t and under(p, q) for u, p in leaves) for t, q, g in paths}


def levels_by_hand(edges, sources):
    inputs = {}
    for c, i in edges:
        inputs.setdefault(c, set()).add(i)
    level, moved = {}, True
    while moved:
        moved = False
        for c, own in inputs.items():
            if c not in level and all(i in sources or i in level for i in own):
                level[c], moved = 1 + max(0 if i in sources else level[i] for i in own), True
    return level


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(c, rnd.randrange(max(0, c - 7), c) if rnd.random() < 0.95 else rnd.randrange(70)) for c in range(4, 60) for _ in range(rnd.choice([1, 1, 2, 3]))]
    sources = {0, 1, 2, 3, 30}
    got = lineage.topological_levels(spark.createDataFrame(edges, "claim_id long, input_id long"), spark.createDataFrame([(s,) for s in sources], "id long"))
    assert {r.claim_id: r.level for r in got.collect()} == levels_by_hand(edges, sources)


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    cuts = []
    keep = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: (cuts.append(1), keep(df))[1])
    edges = [(c, c - 1) for c in range(1, 5001)] + [(9001, 9003), (9002, 9001), (9003, 9002), (9004, 9003), (9005, 9005), (9006, 8000)]
    got = lineage.topological_levels(spark.createDataFrame(edges, "claim_id long, input_id long"), spark.createDataFrame([(0,)], "id long"))
    assert {r.claim_id: r.level for r in got.collect()} == {c: c for c in range(1, 5001)}
    assert len(cuts) < 60


def test_extractor_cases(spark):
    docs = [("p", "<h3>Wait</h3><p>ten</p><li>ten</li><h2>T</h2><table><tr><th>A</th><th>B</th></tr><tr><td>x</td><td>1</td></tr></table>"
             "<h2>From 1 January 2027</h2><table><tr><th>A</th><th>C</th></tr><tr><td>x</td><td>2</td></tr></table><h2>From 1 January 2026</h2><table><tr><th>A</th><th>C</th></tr><tr><td>x</td><td>3</td></tr></table>"),
            ("c", '﻿k,v\n"a ""q"", b",1\nn,'), ("x", "<!DOCTYPE a><a><b>1</b></a>"), ("j", '{"a":{"0":[5]},"b":null}'), ("bad", "{")]
    specs = [
        ("two", "p", "html-section-text", {"heading": "Wait", "anchor": "ten"}), ("old", "p", "html-table-record", {"section": "From 1 January 2026", "headers": "A|C", "row": "x", "column": "C"}),
        ("new", "p", "html-table-record", {"section": "From 1 January 2027", "headers": "A|C", "row": "x", "column": "C"}), ("col", "p", "html-table", {"headers": "A|B", "column": "B"}),
        ("csv", "c", "csv-cell", {"key_column": "k", "key": 'a "q", b', "column": "v", "value_type": "number"}), ("nocol", "c", "csv-cell", {"key_column": "k", "key": "n", "column": "w"}),
        ("dtd", "x", "xml-selector", {"selector": "b"}), ("deep", "j", "json-pointer", {"pointer": "/a/0/0"}), ("null", "j", "json-pointer", {"pointer": "/b"}),
        ("whole", "bad", "json-pointer", {"pointer": "/"}), ("noslash", "j", "json-pointer", {"pointer": "a"}), ("sel", "j", "json-selector", {"selector": "a", "unit": "u"}),
    ]
    got = extraction.extract_values(spark.createDataFrame(specs, "spec_id string, document string, mode string, params map<string,string>"), spark.createDataFrame(docs, "document string, body string"))
    by = {r.spec_id: (r.value, r.hits, r.problem) for r in got.collect()}
    assert by == {
        "two": (None, 2, "NOT_ONE"), "old": (None, 0, "NOT_ONE"), "new": ("2", 1, None), "col": ('["1"]', 1, None), "csv": ("1", 1, None), "nocol": (None, 1, None),
        "dtd": (None, 0, "NOT_ONE"), "deep": ("5", 1, None), "null": (None, 1, None), "whole": (None, 0, "NOT_ONE"), "noslash": (None, 0, "NOT_ONE"), "sel": ('{"0":[5]}', 1, None)}


@pytest.mark.parametrize("label, rate, want", [
    ("$0 – $18,200", "0%", ("0", "18200", "0")), ("18,201 to 45,000", "16.50 %", ("18201", "45000", "0.1650")), ("Over 45,000", "100%", ("45000", None, "1.00")),
    ("45,000+", "3%", ("45000", None, "0.03")), ("45,000", "3%", None), ("a to b", "3%", None), ("1 to 2", "3", None), ("1 to 2 to 3", "3%", None), (None, "3%", None),
])
def test_bracket_labels(spark, label, rate, want):
    df = spark.createDataFrame([(label, rate)], "l string, r string")
    b = df.select(rates.bracket_of_label(F.col("l"), F.col("r")).alias("b")).first().b
    show = lambda x: None if x is None else f"{x.normalize():f}"
    assert (None if b is None else (show(b.lower), show(b.upper), b.rate_text)) == want


def test_bound_values_by_type(spark):
    docs = variant(spark.createDataFrame([("p", '{"n":1.50,"l":[1,2],"s":"t","b":[[5,0.1],["Infinity",0.2]],"m":[1,"x"],"o":{}}')], "page string, j string")).withColumnRenamed("v", "document")
    rows = spark.createDataFrame([("p", x) for x in ("n", "l", "s", "b", "m", "o", "zz")], "page string, runtime_path string")
    got = {r.runtime_path: (r.numbers and [float(x) for x in r.numbers], r.text, r.brackets and [(x.cap and float(x.cap), float(x.rate)) for x in r.brackets], r.type, r.path_problem)
           for r in bindings.bound_values(rows, docs).collect()}
    assert got == {"n": ([1.5], None, None, "number", None), "l": ([1, 2], None, None, "array", None), "s": (None, "t", None, "string", None),
                   "b": (None, None, [(5, 0.1), (None, 0.2)], "array", None), "m": (None, None, None, "array", None), "o": (None, None, None, "object", None), "zz": (None, None, None, None, "no-property")}


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "attestation long, mode string, claims array<string>, leaf_count int")
    assert {(r.metric, r.n, r.code) for r in lineage.attestation_audit(empty).collect()} == {(m, 0, None) for m in ("attestations", "claims", "leaves", "live", "extract", "fixture-only")}


def test_trend_stream_late_rows_and_touched_keys(spark, tmp_path):
    log = "request_key string, observation_id string, observed_at timestamp_ntz, status string"
    at = lambda m: f"timestamp_ntz'2026-01-01 00:{m:02d}:00'"
    batches = [
        [("a", "1", 10, "transient"), ("b", "2", 11, "match"), ("c", "9", 12, "transient")],
        [("a", "3", 20, "transient"), ("a", "3", 20, "transient"), ("b", "4", 21, "transient")],
        [("a", "late", 15, "match"), ("b", "late2", 5, "transient"), ("a", "1", 10, "transient"), ("a", "5", 30, "match")],
    ]
    for rows in batches:
        one = spark.createDataFrame([(k, o, s, m) for k, o, m, s in rows], "request_key string, observation_id string, status string, m int")
        one.selectExpr("request_key", "observation_id", f"timestampadd(MINUTE, m, {at(0)}) AS observed_at", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = trend.start_trend_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    state = {r.request_key: (r.streak, r.last_status, r.first_seen.minute, [e.observation_id for e in r.events]) for r in trend.finished_state(spark, q, str(tmp_path / "state")).collect()}
    assert state == {"a": (0, "match", 10, ["1", "3", "5"]), "b": (1, "transient", 21, ["4"]), "c": (1, "transient", 12, ["9"])}
    assert {(r.request_key, r.observation_id, r.observed_at.minute) for r in trend.late_observations(spark, str(tmp_path / "state")).collect()} == {("a", "late", 15), ("b", "late2", 5)}
    third = spark.read.parquet(str(tmp_path / "state" / "batch=2")).filter("kind = 'state'").collect()
    assert [r.request_key for r in third] == ["a"]


@pytest.mark.parametrize("seed", range(2))
def test_close_pairs_counted_by_cells(spark, seed):
    import math

    from trustframe.operators import entities

    rnd = random.Random(seed)
    spread = 0.004 if seed else 0.0008
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.choice(["", "x"]), round(-36.8 + rnd.random() * spread, 4 + seed), round(174.7 + rnd.random() * spread, 5)) for i in range(400)]

    def metres(p, q):
        a, b, c, d = map(math.radians, (p[3], p[4], q[3], q[4]))
        return 2 * 6371000 * math.asin(math.sqrt(min(1, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    df = spark.createDataFrame(rows, "id int, name_key string, contact_key string, lat double, lng double")
    assert entities.near_duplicate_count(df.filter("name_key is not null")).first().pairs == sum(
        1 for i, p in enumerate(rows) for q in rows[:i] if p[1] and q[1] and (p[1] == q[1] or p[2] and p[2] == q[2]) and (p[3:] == q[3:] or metres(p, q) <= 200))


def test_a_dense_cell_lists_one_row(spark):
    from trustframe.operators import entities

    df = spark.range(20_000).select(F.col("id"), F.lit("n").alias("name_key"), F.lit("").alias("contact_key"), (F.lit(-36.8) + F.col("id") * 1e-9).alias("lat"), F.lit(174.7).alias("lng"))
    (row,) = entities.near_duplicate_cells(df).collect()
    assert (row.first_id, row.second_id, row.pairs) == (0, None, 20_000 * 19_999 // 2)


@pytest.mark.parametrize("name", ["category_facts", "claim_registry", "directory_registry", "bindings_check", "selector_values", "parts", "suppliers"])
def test_rows_are_dealt_before_work_on_each(spark, small, name):
    """A small compressed table is one split; the work on its rows is not one task's."""
    from trustframe.plans.evidence import part_documents, supplier_documents
    from trustframe.plans.registry import all_plans

    run = {"parts": part_documents, "suppliers": supplier_documents}.get(name) or all_plans()[name].run
    assert "REPARTITION_BY_NUM" in run(spark, small)._jdf.queryExecution().executedPlan().toString()
