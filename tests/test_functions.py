import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import arrays, classify, dates, fingerprints, geo, numbers, text, urls, variants


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def run(spark, values, expr, kind="string"):
    df = col(spark, values, kind).withColumn("i", F.monotonically_increasing_id())
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


X = F.col("x")


def test_names_and_keys(spark):
    vals = ["Ｂ&C  Orchard-Ltd", "Straße Café", "Ab_c", "키위 농장 A&B"]
    assert run(spark, vals, text.norm_name(X)) == ["b and c orchard ltd", "strasse café", "ab_c", "키위 농장 a and b"]
    assert run(spark, vals[:2], text.norm_key(X)) == ["bandcorchardltd", "straecaf"]
    assert run(spark, vals[3:], text.norm_key_hangul(X)) == ["키위농장ab"]
    assert run(spark, [" a \n b\t"], text.collapse_ws(X)) == ["a b"]


def test_slug_and_ids(spark):
    assert run(spark, ["Tōtara & Sons Ltd.", "농장", "a" * 60], text.slug(X)) == ["totara-and-sons-ltd", "entry", "a" * 48]
    import hashlib

    want = "nz-acme-" + hashlib.sha256("NZ\0src\0Acme\0b".encode()).hexdigest()[:8]
    got = run(spark, ["Acme"], fingerprints.stable_id(F.lit("NZ"), F.lit("src"), X, F.lit("b")))
    assert got == [want]
    full = hashlib.sha256("fee|a b".encode()).hexdigest()[:20]
    assert run(spark, ["a  b"], fingerprints.fact_fingerprint(F.lit("fee"), X)) == ["sha256:" + full]


def test_labels(spark):
    assert run(spark, [None, "mailto:a@b.nz", "https://x.nz/careers", "https://x.nz"], text.contact_kind(X)) == [
        "none", "email", "recruitment", "company"]
    assert run(spark, ["광업", "other"], text.work_type(X)) == ["mining", "other"]
    assert run(spark, ["Bay of Plenty", "Te Puke"], text.precision_of(F.lit("NZ"), X)) == ["region", "town"]


def test_urls(spark):
    good = ["https://a.govt.nz/x?y=1", "http://a.nz", "https://A.nz", "https://u@a.nz", "https://a.nz#f", "https://", None]
    assert run(spark, good, urls.is_https(X)) == [True, False, False, False, False, False, False]
    hosts = ["www.a.govt.nz", "govt.nz", "a.b.com.au", "x.y.example.org", "single"]
    assert run(spark, hosts, urls.registrable_host(X)) == ["a.govt.nz", "govt.nz", "b.com.au", "example.org", "single"]
    assert run(spark, ["a.b.c"], urls.host_suffixes(X)) == [["a.b.c", "b.c", "c"]]
    assert run(spark, ["evil-ird.govt.nz", "www.ird.govt.nz", "ird.govt.nz.evil.com"], urls.host_under(X, ["ird.govt.nz"])) == [
        False, True, False]
    urls_in = ["HTTPS://Ex.COM:443/a?b=1#c", "http://ex.com:8080/", "ftp://ex.com", "https://bücher.de/x"]
    assert run(spark, urls_in, urls.normalize_source_url(X)) == [
        "https://ex.com/a?b=1#c", "http://ex.com:8080/", None, "https://xn--bcher-kva.de/x"]
    assert run(spark, ["https://Ex.com/a//", "https://ex.com", "https://ex.com/?q=1"],
               urls.canonical_contact(F.lit("company"), X)) == ["https://ex.com/a", "https://ex.com/", "https://ex.com/?q=1"]
    assert run(spark, ["mailto:a.b@c.nz", "mailto:a@b?x", "mailto:a..b@c.nz"], urls.is_mailto(X)) == [True, False, False]


def test_dates(spark):
    d = dt.date
    assert run(spark, ["2026-07-19", "2026-7-19", "2026-02-30", "2026", "2026-07-19\n"], dates.strict_date(X)) == [
        d(2026, 7, 19), None, None, None, None]
    assert run(spark, ["1 july 2026", "31 JULY 2026", "1 Foo 2026"], dates.english_date(X)) == [d(2026, 7, 1), d(2026, 7, 31), None]
    assert [v is not None for v in run(spark, ["2026-07-19T00:00:00Z", "2026-07-19T00:00:00", "2026-07-19T00:00:00+09:00"],
                                       dates.zoned_timestamp(X))] == [True, False, True]
    labels = ["Tax rates for resident taxpayers for 2026–27", "Tax rates for resident taxpayers for 2026–28",
              "From 1 July 2026", "If you apply on or after April 30, 2026", "Other"]
    assert run(spark, labels, dates.cohort_date(X)) == [d(2026, 7, 1), None, d(2026, 7, 1), d(2026, 4, 30), None]


def test_number_tokens(spark):
    texts = ["fee $1,234.50 and 12k, v2 x3 4_5 10m"]
    assert run(spark, texts, numbers.number_tokens(X)) == [["1,234.50", "12k", "10m"]]
    long = run(spark, ["123456789012345", "0012,345,678,901,234,567.50", "1.23456789k", "1.5m", "0.0005k"], numbers.canonical_token(X))
    assert long == ["123456789012345", "12345678901234567.5", "1234.56789", "1500000", "0.5"]
    vals = run(spark, ["1,234.50", "12k", "0.0", "3m"], numbers.canonical_token(X))
    assert vals == ["1234.5", "12000", "0", "3000000"]


def test_tokens_in_context(spark):
    body = "Visa fee is $900. Valid 2026-07-01 for 12 months; age 18 years old"
    got = run(spark, [body], numbers.tokens_in_context(X))[0]
    assert [t.token for t in got] == ["900", "2026", "07", "01", "12", "18"]
    assert [t.in_date for t in got] == [False, True, True, True, False, False]
    assert got[0].clause == "Visa fee is $900" and got[0].left == "fee is $" and got[0].right == ". Valid 2026"
    assert got[4].clause == " Valid 2026-07-01 for 12 months"


def test_neighbourhoods_count_characters(spark):
    """A character beyond U+FFFF before a number counts once, and the number keeps its place among the others."""
    got = run(spark, ["a \U0001F600 fee $12 and 345 days"], numbers.tokens_in_context(X))[0]
    assert [(t.token, t.left, t.right) for t in got] == [("12", " \U0001F600 fee $", " and 345 day"), ("345", "$12 and ", " days")]


def test_text_transforms(spark):
    t = numbers.text_transform
    cases = {
        "single-iso-amount-to-number": [("NZD $1,240", 1240.0), ("NZD 1 and AUD 2", None)],
        "single-dollar-amount-to-number": [("pay $23.50 now", 23.5), ("US$5", None)],
        "single-hourly-dollar-amount-to-number": [("$23.95 per hour", 23.95), ("$23.95 a day", None)],
        "leading-currency-to-number": [("NZD $770 plus", 770.0), ("fee NZD $770", None)],
        "percent-to-decimal": [("rate 12 %", 0.12)],
        "embedded-percent": [("$1.75 per $100 (1.75%)", 1.75), ("$1.70 per $100 (1.75%)", None)],
        "percentage-number-to-decimal": [("15", 0.15), ("101", None)],
        "identical-duration-days": [("30 days or 30 days", 30.0), ("30 days", None), ("30 days, 31 days", None)],
        "single-duration-days-to-months": [("180 days", 6.0), ("181 days", None)],
        "single-duration-years-to-months": [("3 years", 36.0)],
        "duration-months": [("6 mois", 6.0)],
        "duration-weeks": [("7.5 weeks", 7.5)],
        "service-standard-months": [("6-month service standard for 80% of cases", 6.0), ("6-month service standard", None)],
        "inclusive-range": [("18 to 35", "18-35"), ("be between the ages of 18 and 30 (inclusive)", "18-30"),
                            ("between the ages of 18-30", None), ("35-18", None)],
        "final-inclusive-range": [("1-2 and 18–35", "18-35"), ("18-35", None)],
        "integer": [("about 10,239", 10239.0), ("1.5", None)],
    }
    for name, pairs in cases.items():
        assert run(spark, [p[0] for p in pairs], t(name, X)) == [p[1] for p in pairs], name
    with pytest.raises(ValueError):
        t("eval", X)


def test_typed_cells(spark):
    assert run(spark, ["1,000", "10.5", "x"], numbers.typed_cell(X, "integer")) == [1000.0, None, None]
    assert run(spark, ["10.5 %", "10"], numbers.typed_cell(X, "percent-to-decimal")) == [0.105, None]
    assert run(spark, ["-", "5"], numbers.typed_cell(X, "nullable-number", "-")) == [None, 5.0]


def test_rounding_half_up(spark):
    assert run(spark, [43230.5, -0.5, 2.5, -1.5], numbers.round_half_up(X), "double") == [43231, 0, 3, -1]


def test_brackets_text(spark):
    df = spark.sql("select array(named_struct('cap', 18200D, 'rate', 0D), named_struct('cap', 135000D, 'rate', 0.3D), "
                   "named_struct('cap', cast(null as double), 'rate', 0.45D)) b")
    row = df.select(arrays.serialize_brackets(F.col("b")).alias("s"),
                    arrays.serialize_brackets(F.col("b"), rate_text=arrays.rate_keeping_scale).alias("k")).first()
    assert row.s == "18200@0;135000@0.3;above@0.45" and row.k == "18200@0;135000@0.30;above@0.45"
    back = run(spark, [row.s, "1@2;x", "5@0.1"], arrays.parse_brackets(X))
    assert [(r.cap, r.rate) for r in back[0]] == [(18200.0, 0.0), (135000.0, 0.3), (None, 0.45)]
    assert back[1] is None and len(back[2]) == 1


def test_value_transforms(spark):
    df = spark.createDataFrame(
        [("identity", [3.0], None, None), ("multiply", [0.105], None, 100.0), ("sum", [1.5, 2.5], None, None),
         ("sum", [1.0], None, None), ("joinRange", [18.0, 35.0], None, None), ("extractRange", [], "4,000~5,000 won", None),
         ("extractRange", [], "none", None)], "op string, n array<double>, t string, f double")
    expr = arrays.transform_value(F.col("op"), F.col("n").cast("array<decimal(38,18)>"), F.col("t"), F.col("f").cast("decimal(38,18)"))
    assert [r.v for r in df.select(expr.alias("v")).collect()] == ["3", "10.5", "4", None, "18-35", "4000-5000", None]
    assert run(spark, ["18-35", "15600@0.105;above@0.39", "12"], arrays.boundary_values(X)) == [
        ["18", "35"], ["15600", "0.105", "0.39"], ["12"]]


def test_leaves_and_types(spark):
    doc = '{"a":{"b~/":[1,1.50,true]},"e":{},"n":null,"s":"t"}'
    df = spark.createDataFrame([("d", doc)], "id string, j string").withColumn("v", F.try_parse_json("j"))
    rows = {(r.pointer, r.leaf_type, r.leaf_value) for r in variants.explode_leaves(df, "v", ["id"], 5).collect()}
    assert rows == {("/a/b~0~1/0", "number", "1"), ("/a/b~0~1/1", "number", "1.5"), ("/a/b~0~1/2", "boolean", "true"),
                    ("/e", "object", "{}"), ("/n", "null", None), ("/s", "string", "t")}
    shallow = {(r.pointer, r.leaf_type) for r in variants.explode_leaves(df, "v", ["id"], 2).collect()}
    assert ("/a/b~0~1", "too-deep") in shallow
    assert run(spark, ["/", "/a/b"], variants.pointer_ancestors(X)) == [["/"], ["/", "/a", "/a/b"]]
    assert variants.pointer_to_path("/a/0/b~1c") == "$['a'][0]['b/c']"


def test_json_strictness(spark):
    assert run(spark, ['{"a":NaN}', '{"a":1}'], F.try_parse_json(X).isNull()) == [True, False]


def test_distance(spark):
    m = run(spark, [0.0], geo.haversine_m(X, F.lit(0.0), F.lit(0.0), F.lit(1.0)), "double")[0]
    assert abs(m - 111194.93) < 0.1


def test_latency_and_challenge(spark):
    assert run(spark, [0.0, 250.0, 1000.0, 5000.0, 15000.0], classify.latency_bucket(X), "double") == [
        "lt250ms", "250ms-999ms", "1s-4.999s", "5s-14.999s", "15s-plus"]
    bodies = ["<form> <input type=\"password\"> Log in", "<title> Just a moment... </title>", "plain"]
    late = " " * 300_000 + '<form>Log in<input type="password"></form>'
    assert run(spark, [late], classify.challenge_page(F.lit("text/html"), X)) == [True]
    assert run(spark, [late], classify.link_challenge(X)) == [True]
    assert run(spark, bodies, classify.challenge_page(F.lit("text/html; charset=utf-8"), X)) == [True, True, False]


def test_response_profiles_differ(spark):
    login = "<form><input type='password'>sign in"
    df = spark.createDataFrame([(None, True, 404, login, False), (None, True, 503, login, False), (None, False, 401, "x", False),
                                ("timeout", False, None, None, False), (None, True, 200, "ok", True), (None, True, 200, " ", False)],
                               "error string, host boolean, status int, body string, big boolean")

    def cls(profile):
        c = classify.response_class(profile, error=F.col("error"), host_ok=F.col("host"), status=F.col("status"),
                                    body=F.col("body"), media=F.lit("text/html"), too_large=F.col("big"))
        return [r.c for r in df.select(c.alias("c")).collect()]

    assert cls("request") == ["changed", "transient", "unsupported", "transient", "unsupported", "changed"]
    assert cls("result") == ["blocked", "blocked", "unsupported", "transient", "unsupported", "changed"]
    assert cls("link") == ["changed", "transient", "blocked", "transient", "match", "changed"]  # 401 before the host


def test_multiset_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "k int, v string").repartition(3)
    c = spark.createDataFrame([(2, ""), (1, "x"), (2, None)], "k int, v string")
    fp = [fingerprints.report_fingerprint(d, ["k", "v"]).first().fingerprint for d in (a, b, c)]
    assert fp[0] == fp[1] != fp[2]


def test_category_words(spark):
    texts = ["Visa application fee NZD 900", "processing time 5 weeks", "visa stay 12 months", "nothing"]
    assert run(spark, texts, classify.text_categories(X)) == [["fee"], ["processing"], ["duration"], []]
    assert run(spark, ["nz-visa-fee-2026", "au-tax-cap"], classify.id_categories(X)) == [["fee"], ["quota", "tax"]]
    assert set(P.CATEGORY_BY_ID) == set(P.CATEGORY_PATTERNS)


def test_serialized_brackets(spark):
    kind = "array<struct<cap:decimal(38,18),rate:decimal(38,18)>>"
    df = spark.createDataFrame([("[[10,0.3],[null,0.45]]",), ("[[1,null]]",), ("[]",)], "t string").select(
        F.transform(F.from_json("t", "array<array<string>>"), lambda p: F.struct(p[0].alias("cap"), p[1].alias("rate"))).cast(kind).alias("b")
    )
    none = F.lit(None)
    got = [df.select(arrays.transform_value(F.lit("serializeBrackets"), F.array().cast("array<decimal(38,18)>"), none.cast("string"),
                                            none.cast("decimal(38,18)"), F.col("b"), label, scale)).collect() for label, scale in (("above", False), ("rest", True))]
    assert [[r[0] for r in rows] for rows in got] == [["10@0.3;above@0.45", None, None], ["10@0.30;rest@0.45", None, None]]
def test_category_words_say_what_the_patterns_say(spark):
    words = [w for some in P.CATEGORY_WORDS.values() for w in some] + ["age", "Ages", "5 – 6세", "7세다", "30歳", "세", "tax rate", "\u0130", "\u212a", "x", " "]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice((str, str.upper, str.title))(rnd.choice(words)[: rnd.choice((1, 3, 99))]) + rnd.choice(("", " ", "9")) for _ in range(rnd.randrange(1, 4))) for _ in range(600)]
    names = F.array(*map(F.lit, P.CATEGORY_PATTERNS))
    by_words = run(spark, texts, classify.clause_categories(X, names))
    by_patterns = run(spark, texts, F.array_compact(F.array(*[F.when(X.rlike(p), F.lit(name)) for name, p in P.CATEGORY_PATTERNS.items()])))
    assert by_words == by_patterns and all(any(name in found for found in by_words) for name in P.CATEGORY_PATTERNS)


