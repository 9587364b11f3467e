import datetime as dt

from pyspark.sql import functions as F

from trustframe.operators import rules
from trustframe.operators.issues import Rule, issue_counts, run_rules, union_issues, valid_rows

DAY = dt.date


def flags(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def test_stale_boundary_is_inclusive(spark):
    rows = [(DAY(2026, 6, 4), "critical"), (DAY(2026, 6, 3), "critical"), (DAY(2026, 4, 20), "medium"), (DAY(2026, 4, 19), "minor"), (DAY(2020, 1, 1), "other")]
    got = flags(spark, rows, "d date, s string", x=rules.stale(F.col("d"), F.lit("2026-07-19").cast("date"), F.col("s")))
    assert [g["x"] for g in got] == [False, True, False, True, None]


def test_date_modes(spark):
    rows = [("a", None, None), (None, "c", "why"), ("a", "c", "why"), (None, "c", " "), (None, None, None)]
    got = flags(spark, rows, "f string, c string, r string", x=rules.date_mode_conflict(F.col("f"), F.col("c"), F.col("r")))
    assert [g["x"] for g in got] == [False, False, True, True, True]


def test_lifecycle(spark):
    d = DAY
    rows = [("active", d(2026, 1, 1), d(2026, 8, 1), "x"), ("expired", None, d(2026, 1, 1), "x"), ("expired", d(2026, 1, 1), d(2026, 1, 1), "x"),
            ("active", None, d(2026, 7, 18), "x"), ("active", None, d(2026, 8, 1), "unverified"), ("uncertain", None, d(2026, 8, 1), "unverified"),
            ("active", d(2026, 1, 1), d(2026, 7, 1), "unverified")]
    got = flags(spark, rows, "s string, e date, n date, k string",
                x=F.concat_ws(" ", *[F.when(b, F.lit(code)) for code, b in rules.lifecycle_problems(F.col("s"), F.col("e"), F.col("n"), F.col("k"), F.lit("2026-07-19").cast("date")).items()]))
    assert [g["x"] for g in got] == ["ELAPSED_NOT_EXPIRED", "EXPIRED_NOT_ELAPSED", "", "REVIEW_PASSED", "UNVERIFIED_PROMOTED", "", "ELAPSED_NOT_EXPIRED REVIEW_PASSED UNVERIFIED_PROMOTED"]


def test_postcodes_and_boxes(spark):
    rows = [("NT", "0837"), ("NSW", "2600"), ("ACT", "2600"), ("QLD", "837"), ("XX", "2600")]
    got = flags(spark, rows, "s string, p string", x=rules.postcode_outside_state(F.col("s"), F.col("p")))
    assert [bool(g["x"]) for g in got] == [False, True, False, False, False]
    rows = [("NZ", -36.8, 174.7), ("NZ", -33.8, 151.2), ("AU", -33.8, 151.2), ("AU", float("nan"), 151.2)]
    got = flags(spark, rows, "c string, a double, b double", x=rules.outside_box(F.col("c"), F.col("a"), F.col("b")))
    assert [g["x"] for g in got] == [False, True, False, True]


def test_key_rules(spark):
    docs = [('{"a":1,"b":null}',), ('{"a":1}',), ('{"a":1,"b":2,"c":3}',), ("[1]",)]
    got = flags(spark, docs, "j string", miss=rules.missing_keys(F.col("j"), ["a", "b"]), exact=rules.keys_not_exact(F.col("j"), ["a"], ["b"]))
    assert [g["miss"] for g in got] == [[], ["b"], [], None]
    assert [g["exact"] for g in got] == [False, False, True, True]


def test_text_and_enum_rules(spark):
    rows = [("ok", ["mining"]), (" pad", ["mining", "mining"]), ("a\x01b", []), ("", ["cars"]), (None, None)]
    got = flags(spark, rows, "t string, w array<string>", t=rules.unsafe_text(F.col("t")), w=rules.bad_enum_array(F.col("w"), ["mining", "nursery"]))
    assert [g["t"] for g in got] == [False, True, True, True, True]
    assert [g["w"] for g in got] == [False, True, True, True, True]
    got = flags(spark, [("a-b",), ("a-b\n",), ("A",)], "t string", x=rules.not_matching(F.col("t"), r"[a-z]+(?:-[a-z]+)*"))
    assert [g["x"] for g in got] == [False, True, True]


def test_paths(spark):
    rows = [("nz/index.html",), ("/etc/x",), ("../x",), ("a/../../x",), ("a/./../b",), ("a//../b",)]
    assert [g["x"] for g in flags(spark, rows, "p string", x=rules.path_escapes(F.col("p")))] == [False, True, True, True, False, False]


def test_hosts(spark):
    rows = [("government-register", "NZ", "www.x.govt.nz"), ("government-register", "AU", "www.x.govt.nz"), ("industry-association", "NZ", "nzkgi.org.nz"),
            ("employer-official", "NZ", "a.govt.nz"), ("verified-local-producer", "AU", "x.qld.gov.au"), ("unverified", "AU", "any.com")]
    got = flags(spark, rows, "k string, c string, h string", x=rules.source_host_conflict(F.col("k"), F.col("c"), F.col("h")))
    assert [g["x"] for g in got] == [False, True, False, True, False, False]


def test_eligibility(spark):
    rows = [("NZ", "nz-whv-extension", "conditional", True, False), ("NZ", "nz-whv-extension", "conditional", True, True), ("AU", "none", "not-applicable", True, False),
            ("AU", "au-417-specified-work", "conditional", True, None), ("AU", "none", "conditional", True, True)]
    got = flags(spark, rows, "c string, s string, k string, r boolean, l boolean",
                x=rules.eligibility_conflict(F.col("c"), F.col("s"), F.col("k"), F.col("r"), F.col("l")))
    assert [g["x"] for g in got] == [False, True, False, True, True]


def test_page_contract(spark):
    good = '<!DOCTYPE html><html lang="ko"><head><title>T</title>'
    got = flags(spark, [(good,), (good.replace("ko", "en"),), ("x" * 100 + good,)], "h string", x=rules.page_contract_breaks(F.col("h"), F.lit("ko"), F.lit("T")))
    assert [g["x"] for g in got] == [[], ["LANGUAGE"], ["DOCTYPE"]]


def test_constants(spark):
    rows = [(0.0595, 0.0495, 0.01, 1.0, 2.0), (0.06, 0.0495, 0.01, 1.0, 2.0), (0.0595, 0.0495, 0.01, 2.0, 2.0)]
    got = flags(spark, rows, "r double, b double, a double, l double, h double", x=rules.constants_inconsistent(*[F.col(c) for c in "rbalh"]))
    assert [g["x"] for g in got] == [False, True, True]


def test_run_rules_reports_every_violation(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "bad", 5)], "id int, status string, n int")
    issues = run_rules(df, "t", F.col("id"), [
        Rule("STATUS", "status", rules.not_in(F.col("status"), ["x"]), F.col("status"), "x", dims={"n": F.col("n")}),
        Rule("HIGH", "n", F.col("n") > 3, F.col("n"), "<= 3"),
    ])
    got = sorted((r.code, r.entity_id, r.actual, r.expected) for r in issues.collect())
    assert got == [("HIGH", "2", "5", "<= 3"), ("STATUS", "2", "bad", "x")]
    assert {r.code: r.issues for r in issue_counts(union_issues([issues, issues])).collect()} == {"HIGH": 2, "STATUS": 2}
    assert [r.id for r in valid_rows(df, "id", issues).collect()] == [1]


def test_state_contract(spark):
    ts = dt.datetime
    ev = [("o1", "transient", ts(2026, 1, 1)), ("o2", "ready", ts(2026, 1, 2))]
    rows = [(0, ts(2026, 1, 1), ts(2026, 1, 2), ts(2026, 1, 2), "ready", "o2", ev), (1, ts(2026, 1, 1), ts(2026, 1, 2), None, "ready", "o2", ev),
            (0, ts(2026, 1, 1), ts(2026, 1, 2), None, "ready", "o1", list(reversed(ev)))]
    schema = ("streak bigint, a timestamp_ntz, b timestamp_ntz, r timestamp_ntz, s string, o string, "
              "e array<struct<observation_id:string,status:string,observed_at:timestamp_ntz>>")
    got = flags(spark, rows, schema, x=rules.state_contract_breaks(*[F.col(c) for c in ("streak", "a", "b", "r", "s", "o", "e")]))
    assert got[0]["x"] == [] and got[1]["x"] == ["ACTIVE_STATUS"]
    assert set(got[2]["x"]) == {"EVENT_ORDER", "LAST_STATUS", "LAST_TIME", "RECOVERY"}


def test_white_space_is_unicode(spark):
    rows = [("\t",), ("\n",), ("\u00a0",), ("\u3000",), ("\u3000a",), ("a\u00a0",), ("a b",), (None,)]
    got = flags(spark, rows, "t string", b=rules.blank(F.col("t")), u=rules.unsafe_text(F.col("t")))
    assert [g["b"] for g in got] == [True, True, True, True, False, False, False, True]
    assert [g["u"] for g in got] == [True] * 6 + [False, True]
