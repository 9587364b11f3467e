import datetime as dt
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.operators import coverage as C
from trustframe.operators import drift as D
from trustframe.operators import entities as E
from trustframe.operators import filters, lineage, pages, ranking, rates
from trustframe.operators import reconcile as R
from trustframe.functions import numbers
from trustframe.streaming import trend as S


def rowset(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# ---- rates -----------------------------------------------------------------------------

def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_golden_net_pay(spark):
    nz = rates.net_pay_nz(F.lit(72800.0), P.NZ_RATES)
    whm = rates.net_pay_au(F.lit(52115.0), "whm", P.AU_RATES)
    res = rates.net_pay_au(F.lit(60000.0), "resident", P.AU_RATES)
    got = one(spark, nz=nz["net"], whm=whm["net"], res=res["net"])
    assert (got.nz, got.whm, got.res) == (57466, 43231, 50380)
    ca = rates.net_pay_ca(spark.createDataFrame([(60000.0,)], "g double"), "g", P.CA_RATES).first()
    assert ca.net_on == 47340


def test_probe_counts(spark):
    counts = {t: 3 * len(rates.thresholds(t, r)) for t, r in (("nz", P.NZ_RATES), ("ca", P.CA_RATES), ("au", P.AU_RATES))}
    assert counts == {"nz": 15, "ca": 69, "au": 24}  # nz is probed for two editions
    sem = spark.createDataFrame([("inclusive-range", 18.0, 35.0)] * 2 + [("maximum", None, 12.0)] * 4, "k string, lo double, hi double")
    assert rates.semantic_probes(sem, F.col("k"), F.col("lo"), F.col("hi"), F.lit(1.0)).count() == 20
    assert 2 * counts["nz"] + counts["ca"] + counts["au"] + 20 == 143


def test_table_form_equals_closed_form(spark):
    vals = [0.0, 1.0, 15599.99, 15600.0, 15601.0, 180000.0, 1e6]
    df = spark.createDataFrame([(v, "nz") for v in vals], "g double, s string")
    t = spark.createDataFrame([("nz", i, c if c is None else float(c), r) for i, (c, r) in enumerate(P.NZ_RATES["brackets"])], "s string, seq int, cap double, rate double")
    out = rates.progressive_by_table(df.withColumnRenamed("s", "scope"), "g", t.withColumnRenamed("s", "scope"), "scope")
    for r in out.withColumn("closed", rates.progressive(F.col("g"), P.NZ_RATES["brackets"])).collect():
        assert abs(r.tax - r.closed) < 1e-9


def test_bracket_and_taper_rules(spark):
    good = [("g", i, c, r) for i, (c, r) in enumerate([(10.0, 0.1), (20.0, 0.2), (None, 0.3)])]
    bad = [("b", 0, 10.0, 0.1), ("b", 1, 10.0, -0.2), ("b", 2, 30.0, 0.3)]
    df = spark.createDataFrame(good + bad, "t string, seq int, cap double, rate double")
    for width in (1, 2, 100):  # block width must not matter
        got = rowset(rates.bracket_problems(df, ["t"], F.floor(F.col("seq") / width)))
        assert got == [("b", 1, "CAP_NOT_INCREASING"), ("b", 1, "NEGATIVE_RATE"), ("b", 2, "LAST_NOT_OPEN")]
    o = P.AU_RATES["offset"]
    codes = rates.taper_problems(*[F.lit(float(v)) for v in (700, 37500, 45000, 0.05, 325, 66667, 0.015)])
    assert one(spark, x=codes).x == [] and o["cut_out"] == 66667
    assert one(spark, x=rates.taper_problems(*[F.lit(float(v)) for v in (700, 37500, 45000, 0.05, 326, 66667, 0.015)])).x == ["SECOND_OFFSET", "CUT_OUT"]


def test_points(spark):
    rows = [(77, 1, "points"), (120, 1, "points"), (17, 4, "points"), (40, 1, "points")]
    df = spark.createDataFrame([("p", *r) for r in rows], "k string, v int, m int, u string")
    assert R.weighted_sum(df, ["k"], F.col("v"), F.col("m"), F.col("u"), F.lit("points")).first().total == 305
    assert R.weighted_sum(df, ["k"], F.col("v"), F.col("m"), F.col("u"), F.lit("x")).first().total is None


# ---- ranking ---------------------------------------------------------------------------

def test_running_is_independent_of_blocks(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}", i, rnd.randrange(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    expected = {}
    state = {}
    for k, i, v in rows:
        n, s = state.get(k, (0, 0))
        state[k] = (n + 1, s + v)
        expected[(k, i)] = state[k]
    for width in (1, 10, 1000):
        out = ranking.running(df, ["k"], [F.col("i")], F.floor(F.col("i") / width), {"total": F.col("v")}, row_number="n")
        assert {(r.k, r.i): (r.n, r.total) for r in out.collect()} == expected


def test_duplicates_and_baselines(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 4, 1), (None, 5, 1), (None, 6, 1)], "k string, o int, v int")
    assert rowset(ranking.duplicate_rows(df, ["k"], "o"), "o", "first_ord") == [(2, 1), (3, 1), (6, 5)]
    assert rowset(ranking.deviating_rows(df, ["k"], "o", ["v"]), "o", "base_v") == [(3, 5)]
    assert rowset(ranking.last_n(df, ["k"], [F.col("o").desc()], 1), "o") == [(3,), (4,), (6,)]


# ---- reconcile -------------------------------------------------------------------------

def test_leaf_ownership(spark):
    leaves = spark.createDataFrame([("t", p) for p in ("/a/0", "/a/1", "/b", "/ab")], "t string, leaf string")
    maps = spark.createDataFrame([("t", "/a", "x"), ("t", "/a/1", "y"), ("t", "/ab", "z")], "t string, p string, o string")
    assert rowset(R.leaf_owners(leaves, maps, "t", "leaf", "p")) == [("t", "/a/0", 1), ("t", "/a/1", 2), ("t", "/ab", 1), ("t", "/b", 0)]
    assert rowset(R.mapping_overlaps(maps, "t", "p", "o")) == [("t", "/a/1", "y", "x", "/a")]


def test_full_reconcile_and_sets(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rowset(R.full_reconcile(a, b, ["k"]), "k", "outcome") == [(1, "ORPHAN"), (2, "DUPLICATE"), (3, "MISSING")]
    assert rowset(R.set_difference(a, b, ["k"])) == [(1, "left", 1), (2, "left", 1), (3, "right", 1)]
    assert rowset(R.not_exactly_one(a, b, ["k"])) == [(1, 0)]


def test_range_join_edges(spark):
    p = spark.createDataFrame([("a", 5), ("a", 10), ("a", 31), ("b", 5)], "k string, v int")
    r = spark.createDataFrame([("a", 5, 10, "r1"), ("a", 11, 40, "r2")], "k string, lo int, hi int, n string")
    for width in (1, 7, 100):
        assert rowset(R.range_join(p, r, ["k"], "v", "lo", "hi", width), "v", "n") == [(5, "r1"), (10, "r1"), (31, "r2")]
        assert rowset(R.range_join(p, r, ["k"], "v", "lo", "hi", width, "left_anti"), "k", "v") == [("b", 5)]


# ---- entities --------------------------------------------------------------------------

def hav(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(x))


def test_near_duplicate_count_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        base = rnd.choice([(-36.8, 174.7), (0.0, 179.9995), (0.0, -179.9995), (89.9995, 10.0)])
        rows.append((i, rnd.choice(["n1", "n2"]), rnd.choice(["", "c1", "c2"]), base[0] + rnd.randrange(4) * 0.0008, base[1] + rnd.randrange(4) * 0.0008))
    rows = [(i, n, c, min(la, 90.0), ln) for i, n, c, la, ln in rows]
    brute = sum(
        1 for x in range(len(rows)) for y in range(x)
        if (rows[x][1] == rows[y][1] or (rows[x][2] and rows[x][2] == rows[y][2])) and hav(*rows[x][3:], *rows[y][3:]) <= 200
    )
    df = spark.createDataFrame(rows, "id int, name_key string, contact_key string, lat double, lng double")
    assert E.near_duplicate_count(df).first().pairs == brute > 100
    pairs = E.near_duplicates(df)
    assert pairs.filter("distance_m > 200").count() == 0 and pairs.select("first_id", "second_id").distinct().count() == pairs.count()


def greedy(left, right):
    free, out = list(right), {}
    for i, o, n, la, ln in sorted(left, key=lambda r: r[1]):
        same = [r for r in free if r[2] == n]
        if same:
            best = min(same, key=lambda r: (math.hypot(la - r[3], ln - r[4]), r[1]))
            free.remove(best)
            out[i] = best[0]
    return out


def test_one_to_one_match_equals_greedy(spark):
    rnd = random.Random(11)
    def table(n, start):
        return [(start + i, i, rnd.choice(["hot", "hot", "b"]), rnd.randrange(2000) / 1000 + rnd.random() * 1e-6, rnd.randrange(2000) / 1000) for i in range(n)]
    left, right = table(14, 0), table(11, 100)
    schema = "id int, ord int, name_key string, lat double, lng double"
    m, lost_l, lost_r = E.match_one_to_one(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    want = greedy(left, right)
    assert dict(rowset(m, "left_id", "right_id")) == want
    assert {r.id for r in lost_l.collect()} == {r[0] for r in left} - set(want)
    assert {r.id for r in lost_r.collect()} == {r[0] for r in right} - set(want.values())


def test_one_to_one_match_same_point(spark):
    rows = [(i, i, "n", 1.0, 1.0) for i in range(5)]
    schema = "id int, ord int, name_key string, lat double, lng double"
    m, _, _ = E.match_one_to_one(spark.createDataFrame(rows, schema), spark.createDataFrame([(100 + i, i, "n", 1.0, 1.0) for i in range(3)], schema))
    assert rowset(m, "left_id", "right_id") == [(0, 100), (1, 101), (2, 102)]


def test_refresh_and_migration_steps(spark):
    ent = spark.createDataFrame([("a", "Old", "x", 1.0, 2.0, None, None, "active", None), ("b", "Keep", "y", 3.0, 4.0, None, None, "active", None)],
                                "k string, name string, address string, lat double, lng double, effective_to date, checked_at date, status string, next_review_at date")
    rec = spark.createDataFrame([("a", "New", "z", 1.123456, 2.0, dt.date(2026, 1, 1))], "k string, name string, address string, lat double, lng double, effective_to date")
    out = {r.k: r for r in E.refresh_from_records(ent, rec, "k", F.lit("2026-07-19").cast("date")).collect()}
    assert (out["a"].name, out["a"].lat, out["a"].status, out["a"].next_review_at) == ("New", 1.12346, "expired", dt.date(2026, 7, 19))
    assert out["b"].name == "Keep" and out["b"].checked_at is None
    d = spark.createDataFrame([("NZ", "exact", "", "", ["광업"]), ("AU", "exact", None, "NT", ["x"])], "country string, precision string, region string, state string, work_types array<string>")
    got = E.default_regions(E.downgrade_coordinates(E.refresh_work_types(d))).collect()
    assert (got[0].precision, got[0].work_types, got[1].precision, got[1].region) == ("town", ["mining"], "exact", "NT")


# ---- lineage ---------------------------------------------------------------------------

def test_levels_cycles_and_failures(spark):
    edges = spark.createDataFrame([("d1", "o1"), ("d2", "d1"), ("d2", "o2"), ("d3", "bad"), ("d4", "d3"), ("c1", "c2"), ("c2", "c1"), ("c3", "c1")], "claim_id string, input_id string")
    ok = spark.createDataFrame([("o1",), ("o2",)], "id string")
    got = {r.claim_id: (r.executed, r.level, r.unmet_inputs) for r in lineage.execution_status(edges, ok).collect()}
    assert got["d1"] == (True, 1, 0) and got["d2"] == (True, 2, 0)
    assert not any(got[c][0] for c in ("d3", "d4", "c1", "c2", "c3")) and got["d3"][2] == 1
    assert rowset(lineage.cyclic_claims(edges)) == [("c1",), ("c2",), ("c3",)]


# ---- drift -----------------------------------------------------------------------------

def reference_trend(events):
    state = {}
    for key, obs, at, status in sorted(events, key=lambda e: (e[2], e[1])):
        prior = state.get(key)
        if prior and any(e[0] == obs for e in prior["events"]):
            continue
        ev = (obs, status)
        if status == "transient":
            if prior and prior["last"] == "transient":
                prior.update(streak=prior["streak"] + 1, seen=at, events=(prior["events"] + [ev])[-8:])
            else:
                state[key] = dict(streak=1, first=at, seen=at, rec=None, last="transient", events=[ev])
        elif prior and prior["last"] == "transient":
            prior.update(streak=0, seen=at, rec=at, last=status, events=(prior["events"] + [ev])[-8:])
    return {k: (v["streak"], v["first"], v["seen"], v["rec"], v["last"], [e[0] for e in v["events"]]) for k, v in state.items()}


def make_log(seed=1, keys=6, n=240):
    rnd = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    return [(f"k{rnd.randrange(keys)}", f"o{i:04d}", start + dt.timedelta(minutes=i), rnd.choice(["transient", "transient", "ready", "changed"])) for i in range(n)]


LOG = "request_key string, observation_id string, observed_at timestamp_ntz, status string"


def trend_rows(df):
    return {r.request_key: (r.streak, r.first_seen, r.last_seen, r.recovered_at, r.last_status, [e.observation_id for e in r.events]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trend_batch_equals_sequential(spark, seed):
    log = make_log(seed)
    df = spark.createDataFrame(log, LOG).repartition(5)
    assert trend_rows(D.transient_trend(df)) == reference_trend(log)


def test_trend_merge_and_replay(spark):
    log = make_log(4)
    cut = log[100][2]
    df = spark.createDataFrame(log, LOG)
    first = D.transient_trend(df.filter(F.col("observed_at") <= F.lit(cut)))
    merged = D.merge_trend(first, df.filter(F.col("observed_at") > F.lit(cut)))
    assert trend_rows(merged) == reference_trend(log)
    last = spark.createDataFrame([log[100]], LOG)
    assert trend_rows(D.merge_trend(first, last)) == trend_rows(first)


def test_trend_advance_report_by_report(spark):
    log = [(k, f"run{i}", dt.datetime(2026, 1, 1 + i), s) for i, row in enumerate([("transient", "ready"), ("transient", "transient"), ("ready", "transient"), ("ready", "ready")])
           for k, s in zip(("a", "b"), row)]
    state = S.empty_state(spark)
    for i in range(4):
        report = spark.createDataFrame([r for r in log if r[1] == f"run{i}"], LOG)
        state = D.advance_trend(state, report)
    assert trend_rows(state) == reference_trend(log)
    replay = D.advance_trend(state, spark.createDataFrame([r for r in log if r[1] == "run3"], LOG))
    assert trend_rows(replay) == trend_rows(state)
    assert trend_rows(D.advance_trend(state, spark.createDataFrame([log[0]], LOG))).keys() == {"a"}


def test_trend_stream_equals_batch(spark, tmp_path):
    log = make_log(7, n=120)
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(log[i * 40:(i + 1) * 40], LOG).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = S.start_trend_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 2
    assert trend_rows(S.finished_state(spark, q, str(tmp_path / "state"))) == reference_trend(log)


def test_trend_stream_stretches_of_many_files(spark):
    from trustframe.plans.drifting import stream_in_stretches

    log = make_log(5, keys=40, n=300)
    stretches = [spark.createDataFrame(log[i * 100:(i + 1) * 100], LOG).repartition(3) for i in range(3)]
    q, state = stream_in_stretches(spark, stretches)
    folder = pathlib.Path(state.removeprefix("file:"))
    assert len(list(folder.parent.glob("log/*.parquet"))) == 9 and {p.name for p in folder.glob("batch=*")} == {f"batch={i}" for i in range(-1, 3)}
    assert trend_rows(S.finished_state(spark, q, state)) == reference_trend(log)


def test_trend_processor_takes_many_keys_at_once():
    import pandas as pd

    class States(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    kept = States()
    processor = S.TrendProcessor(8, None)
    processor.init(type("Handle", (), {"getMapState": lambda *_: kept})())
    columns = ["bucket", "request_key", "observation_id", "at", "status"]

    def call(*rows):
        (out,) = processor.handleInputRows((0,), iter([pd.DataFrame([(0, *r) for r in rows], columns=columns)]), None)
        return [(r.request_key, r.kind, r.last_observation_id) for r in out.itertuples()]

    assert call(("a", "1", 10, "transient"), ("b", "2", 11, "match"), ("c", "3", 12, "transient")) == [("a", "state", "1"), ("c", "state", "3")]
    assert call(("b", "4", 5, "transient"), ("a", "5", 20, "ready")) == [("b", "late", "4"), ("a", "state", "5")]
    assert set(kept) == {("a",), ("b",), ("c",)}


def test_fallback_policies(spark):
    def run(policy, *statuses):
        df = spark.createDataFrame([("k", i, s) for i, s in enumerate(statuses)], "k string, i int, s string")
        r = D.fallback_choice(df, ["k"], "i", "s", policy).first()
        return r.final_status, r.decided_by, r.chain_length, r.selected

    assert run("first-match", "transient", "match", "changed") == ("match", 1, 2, 1)
    assert run("first-match", "changed", "match") == ("changed", 0, 1, None)
    assert run("first-match", "transient", "blocked") == ("blocked", 1, 2, None)
    assert run("available-parity", "match", "transient", "changed") == ("changed", 2, 3, 0)
    assert run("available-parity", "transient", "match") == ("match", 1, 2, 1)
    assert run("available-parity", "transient", "blocked") == ("transient", 0, 2, None)


def test_case_actions(spark):
    f = spark.createDataFrame([("new", True, "x"), ("again", True, "x"), ("same", True, "x"), ("diff", True, "y"), ("gone", False, None), ("quiet", False, None)], "k string, has_finding boolean, fingerprint string")
    c = spark.createDataFrame([("again", "closed", "x"), ("same", "OPEN", "x"), ("diff", "open", "x"), ("gone", "open", "x"), ("quiet", "closed", "x")], "k string, state string, fingerprint string")
    acts = D.case_actions(f, c, "k")
    assert dict(rowset(acts, "k", "action")) == {"new": "create", "again": "reopen", "same": "noop", "diff": "update", "gone": "close", "quiet": "noop"}
    after = dict(rowset(D.apply_case_actions(c, acts, "k"), "k", "state"))
    assert after == {"new": "open", "again": "open", "same": "OPEN", "diff": "open", "gone": "closed", "quiet": "closed"}


# ---- pages and coverage ----------------------------------------------------------------

PAGE = """<!doctype html><html><body><h2>Fees</h2><div data-claim-id="nz-visa-fee"><p>Visa fee NZD $900</p></div>
<p>The visa fee is NZD $900 again</p><p>Quota 2,500 places</p><p class="flight">Quota 9,999</p><div style="display: none"><p>Quota 8,888</p></div>
<h3>Rates for you</h3><details><summary>From 1 July 2025</summary><table><caption>Tax</caption><tr><th>Band</th><th>Rate</th></tr><tr><td>low</td><td>10 %</td></tr></table></details>
<details><summary>From 1 July 2026</summary><table><tr><th>Band</th><th>Rate</th></tr><tr><td>low</td><td>11 %</td></tr><tr><td>odd</td></tr></table></details>
<dl><dt>Unit</dt><dd>NZD</dd></dl><script>var x = "<p>Quota 7,777</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def elements(spark):
    return pages.page_elements(spark.createDataFrame([("p1", PAGE), ("p2", None)], "page string, html string"), "page", "html").cache()


def test_coverage_outcomes(spark, elements):
    cand = C.page_candidates(elements)
    got = {(r.category, tuple(r.numbers)): r for r in cand.collect()}
    assert ("quota", ("9999",)) not in got and ("quota", ("7777",)) not in got
    out = C.coverage_outcomes(cand, spark.createDataFrame([], "selector string, fingerprint string, expires_at date"), F.lit("2026-07-19").cast("date"))
    res = sorted((r.category, r.numbers[0], r.outcome) for r in out.collect())
    assert ("fee", "900", "marked") in res and ("quota", "2500", "uncovered") in res
    q = out.filter("outcome = 'uncovered' and array_contains(numbers, '2500')").first()
    ex = spark.createDataFrame([(q.selector, q.fingerprint, dt.date(2026, 7, 19))], "selector string, fingerprint string, expires_at date")
    again = C.coverage_outcomes(cand, ex, F.lit("2026-07-19").cast("date"))
    assert again.filter("outcome = 'exempted'").count() == 1
    late = C.coverage_outcomes(cand, ex, F.lit("2026-07-20").cast("date"))
    assert late.filter("outcome = 'uncovered' and known_exemption").count() == 1


def test_exemption_lifecycle(spark, elements):
    out = C.coverage_outcomes(C.page_candidates(elements), spark.createDataFrame([], "selector string, fingerprint string, expires_at date"), F.lit("2026-07-19").cast("date"))
    q = out.filter("array_contains(numbers, '2500')").first()
    fp = "sha256:" + "0" * 20
    rows = [(1, q.selector, q.fingerprint, "r", "o", "2026-01-01"), (2, q.selector, q.fingerprint, "r", "o", "2027-01-01"), (3, "p1::x", fp, "r", "o", "2027-01-01"), (4, "p1::y", fp, " ", "o", "2027-01-01"), (5, "p1::z", fp, "r", "o", "2026-02-30")]
    ex = spark.createDataFrame(rows, "ord int, selector string, fingerprint string, reason string, owner string, expires_at string")
    codes = sorted((r.code, r.entity_id) for r in C.exemption_issues(ex, out, F.lit("2026-07-19").cast("date")).collect())
    assert codes == sorted([("EXPIRED_EXEMPTION", q.selector), ("DUPLICATE_EXEMPTION", q.selector), ("ORPHAN_EXEMPTION", "p1::x"), ("INVALID_EXEMPTION", "p1::y"), ("INVALID_EXEMPTION", "p1::z")])


def test_tables_and_records(elements):
    rows = pages.table_rows(elements)
    good, bad = pages.typed_table(rows, ["Band", "Rate"], ["nullable-number", "percent-to-decimal"], null_token="low")
    assert sorted(r["values"][1] for r in good.collect()) == [0.1, 0.11]
    assert [r.code for r in bad.collect()] == ["PARTIAL_ROW"]
    old = pages.table_record(rows, "Rates for you", ["Band", "Rate"], "low", "Rate", summary="From 1 July 2025").first()
    new = pages.table_record(rows, "Rates for you", ["Band", "Rate"], "low", "Rate", summary="From 1 July 2026").first()
    assert old.newer_cohort and old.value is None and not new.newer_cohort and new.value == "11 %"
    assert pages.definition_value(elements, "Rates for you", "Unit").first().value == "NZD"


def test_extraction_status(spark):
    a = spark.createDataFrame([("x", "number", "AUD", "5"), ("y", "number", None, "5")], "k string, value_type string, unit string, value_text string")
    b = spark.createDataFrame([("x", "number", "AUD", "5"), ("y", "number", "AUD", "5"), ("z", "number", "AUD", "5")], "k string, value_type string, unit string, value_text string")
    assert rowset(pages.extraction_status(a, b, ["k"])) == [("x", "match"), ("y", "changed"), ("z", "changed")]


def test_contexts_equal_python(spark):
    import re

    rnd = random.Random(9)
    parts = ["fee $1,200", "2026-07-01", "12k", " a1b ", "; ", ". ", "가격 5월 3일", "3.5%", "–", "é7", "+"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    num, cut, date = (re.compile(p) for p in (P.NUMBER_TOKEN, P.CLAUSE_BREAK, P.DATE_SPAN))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", numbers.tokens_in_context(F.col("t")).alias("c")).collect():
        t = texts[r.i]
        want = []
        for m in num.finditer(t):
            left = max([c.end() for c in cut.finditer(t) if c.end() <= m.start()], default=0)
            right = min([c.start() for c in cut.finditer(t) if c.start() >= m.end()], default=len(t))
            want.append((m.group(), t[max(0, m.start() - 8):m.start()], t[m.end():m.end() + 12], t[left:right],
                         any(d.start() <= m.start() and m.end() <= d.end() for d in date.finditer(t))))
        assert [(c.token, c.left, c.right, c.clause, c.in_date) for c in r.c] == want, t


# ---- filters ---------------------------------------------------------------------------

def test_directory_and_season_filters(spark):
    df = spark.createDataFrame([("Acme", "Te Puke", None, ["mining"], "x", "town", "active"), ("Beta", "Levin", "Otago", ["nursery"], "x", "town", "expired")],
                               "name string, label string, region string, work_types array<string>, source_kind string, precision string, status string")
    assert filters.directory_filter(df).count() == 2
    assert [r.name for r in filters.directory_filter(df, q=" OTAGO ").collect()] == ["Beta"]
    assert [r.name for r in filters.directory_filter(df, work_type="mining", status="active").collect()] == ["Acme"]
    s = spark.createDataFrame([("a", [1, 2]), ("b", [3])], "n string, months array<int>")
    assert filters.season_filter(s, 0).count() == 2 and filters.season_filter(s, 3).count() == 1


def test_equal_rows_stay_apart(spark):
    df = spark.createDataFrame([("a.example.com",), ("a.example.com",), ("x.test",)], "host string")
    allow = spark.createDataFrame([("example.com",)], "domain string")
    assert R.allowed_hosts(df, "host", allow).count() == 2


def test_range_of_any_length(spark):
    p = spark.createDataFrame([("k", 5), ("k", 10**11), ("k", 10**11 + 1), ("k", -1)], "k string, v bigint")
    r = spark.createDataFrame([("k", 0, 10**11, "long"), ("k", 5, 5, "point"), ("k", 9, 3, "empty")], "k string, lo bigint, hi bigint, n string")
    got = sorted((x.v, x.n) for x in R.range_join(p, r, ["k"], "v", "lo", "hi", 25).collect())
    assert got == [(5, "long"), (5, "point"), (10**11, "long")]
    left = R.range_join(p, r, ["k"], "v", "lo", "hi", 25, "left_anti")
    assert sorted(x.v for x in left.collect()) == [-1, 10**11 + 1]


def test_range_join_deals_a_full_bucket(spark, tmp_path):
    # 3,000 points and 5,000 ranges of one key and bucket, each read by one task: no task makes more than a part of the pairs
    p = spark.createDataFrame([("k", i % 5, i) for i in range(3000)], "k string, v bigint, point bigint")
    r = spark.createDataFrame([("k", i % 5, i % 5 + 1, i) for i in range(5000)], "k string, lo bigint, hi bigint, n bigint")
    for name, df in (("p", p), ("r", r)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    p, r = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("p", "r"))
    got = R.range_join(p, r, ["k"], "v", "lo", "hi", 25)
    assert got.columns == ["k", "v", "point", "lo", "hi", "n"]
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in parts) == 600 * 1000 * 9 and max(x["count"] for x in parts) < 600 * 1000 * 9 * 0.8
    assert got.select("point", "n").distinct().count() == 600 * 1000 * 9
    assert got.filter(~F.col("v").between(F.col("lo"), F.col("hi"))).isEmpty()


def test_near_duplicates_deal_a_full_cell(spark):
    # 3,000 sites of one name within some metres: the pairs of the one cell are not one task's
    df = spark.range(3000).select(F.col("id"), F.concat(F.lit("n"), F.col("id") * 0).alias("name_key"), F.lit("").alias("contact_key"),
                                  (F.lit(-36.8) + F.col("id") * 1e-9).alias("lat"), F.lit(174.7).alias("lng"))
    parts = E.near_duplicates(df).groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in parts) == 3000 * 2999 // 2 and max(x["count"] for x in parts) < 3000 * 2999 // 2 * 0.8


def test_page_tree_is_linear_and_reads_markers(spark):
    tree = pages._Tree()
    tree.feed("<div>" + "<br>x" * 8000 + "<li>y" * 8000)
    tree.close()
    assert max(tree.parent) == 0 and len(tree.tags) == 16001 and tree.now == -1
    page = "<!-- <p data-claim-id='a'> --><p title='>' data-claim-id=b>x</p><p data-claim-id='c'>y"
    df = spark.createDataFrame([(7, page)], "id bigint, html string")
    assert sorted(map(tuple, pages.page_markers(df, "id", "html").collect())) == [(7, "b"), (7, "c")]


def test_unknown_overrides(spark):
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    over = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    assert [r.entity_id for r in R.unknown_overrides(base, over, "id").collect()] == ["2"]


def test_plain_pages_read_as_by_the_parser():
    """Plain markup is read by one pattern; the lists must be those of the parser, and anything else must be left to it."""
    bits = ["<p>", "</p>", "<li>", "<ul>", "</ul>", '<div id="a">', "</div>", '<p data-claim-id="x">', "<p hidden>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<br>",
            '<a href="/x">', "</a>", "<script>", "</script>", "<script>if(a<b) '</p>'</script>", "<style>p{}</style>", "text", "\n", "1 &amp; 2", "<!DOCTYPE html>"]
    odd = ["<br/>", "<P>", "<!-- c -->", "<a href=/b>", "& x", "<", "<p class='q'>", '<p a="1>2">', "<script>a</b</script>"]
    rnd, plain = random.Random(4), 0
    for i in range(3000):
        body = "".join(rnd.choice(bits + odd * (i % 2)) for _ in range(rnd.randrange(1, 20)))
        whole, got = pages._Tree(), pages._parsed(body)
        whole.feed(body)
        whole.close()
        plain += pages._Tree().read_plain(body)
        assert [(whole.tags, whole.given, whole.parent, whole.line, whole.closed, whole.text(k)) for k in range(len(whole.tags))] == [
            (got.tags, got.given, got.parent, got.line, got.closed, got.text(k)) for k in range(len(got.tags))], body
    assert plain > 800


def test_order_pages_are_dealt_to_all_tasks(spark, small):
    """A small compressed table is one split; its pages are not parsed by one task."""
    from trustframe.plans.pages import order_pages

    assert order_pages(spark, small).rdd.getNumPartitions() == 4


def test_page_elements_of_some_tags(spark):
    whole = pages.page_elements(spark.createDataFrame([("p1", PAGE)], "page string, html string"), "page", "html")
    some = pages.page_elements(spark.createDataFrame([("p1", PAGE)], "page string, html string"), "page", "html", tags=("td", "th"))
    assert sorted(map(str, some.collect())) == sorted(str(r) for r in whole.collect() if r.tag in ("td", "th") or r.own_mark is not None)


def test_page_fact_coverage_of_long_numbers(spark, tmp_path):
    """Numbers of eight digits are no facts: pages with long numbers count in the SQL as they do in the query."""
    import duckdb

    from trustframe.plans.registry import all_plans

    rows = [(n, "<html><body><article></article></body></html>") for n in (5, 99_999, 100_000, 999_999, 1_000_000)]
    spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    plan = all_plans()["page_fact_coverage"]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(plan.sql).fetchall())
    assert rowset(plan.run(spark, str(tmp_path)), "category", "outcome", "n") == want == [("fee", "marked", 12), ("quota", "uncovered", 2)]


def test_numbers_of_a_category_are_made_once(spark):
    """The test for rows without numbers does not make them a second time, and tokens are not cut twice from a clause."""
    df = spark.createDataFrame([("Visa fee NZD $900; age 18 years old",)], "body string")
    facts = C.numeric_facts(df, "body")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1 and plan.count("split(body") == 1
    assert rowset(facts, "category", "numbers") == [("age", ["18"]), ("fee", ["900"])]


def test_links_leave_the_parser_alone(spark, monkeypatch):
    """Texts of other elements are not made for the links of a page."""
    asked = []
    whole = pages.page_elements
    monkeypatch.setattr(pages, "page_elements", lambda *args, **more: asked.append(set(more["tags"])) or whole(*args, **more))
    df = spark.createDataFrame([(1, '<p>x <a href="/y">z</a></p>')], "id int, html string")
    assert [(r.href, r["name"]) for r in pages.page_links(df, "id", "html").collect()] == [("/y", "z")] and asked == [{"a"}]
