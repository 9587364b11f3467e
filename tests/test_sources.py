import json

import pytest
from pyspark.sql import functions as F

from trustframe.functions.variants import json_type
from trustframe.sources import readers, writers


def test_registry_rows_and_root_issues(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"schemaVersion": 1, "generatedAt": "x", "claims": [{"id": "a"}, {"id": "b", "value": None}]}))
    (tmp_path / "nan.json").write_text('{"schemaVersion":1,"generatedAt":"x","claims":[{"v":NaN}]}')
    (tmp_path / "odd.json").write_text('{"schemaVersion":"1","claims":{}}')
    rows = readers.read_registry(spark, str(tmp_path / "good.json"), "claims")
    assert sorted((r.ord, r.row_json) for r in rows.select("ord", "row_json").collect()) == [(0, '{"id":"a"}'), (1, '{"id":"b","value":null}')]
    assert [r.t for r in rows.orderBy("ord").select(json_type(F.try_variant_get("row", "$.value", "variant")).alias("t")).collect()] == [None, "null"]
    issues = readers.registry_root_issues(spark, str(tmp_path), ["schemaVersion", "generatedAt", "claims"], "claims")
    got = sorted((r.entity_id.rsplit("/", 1)[-1], r.code) for r in issues.collect())
    assert got == [("nan.json", "NOT_JSON"), ("odd.json", "NO_ARRAY"), ("odd.json", "ROOT_KEYS"), ("odd.json", "VERSION")]


def test_pages_must_be_utf8(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>가</p>", encoding="utf-8")
    (tmp_path / "b.html").write_bytes(b"\xff\xfe<p>")
    pages, issues = readers.read_pages(spark, str(tmp_path))
    assert [r.html for r in pages.collect()] == ["<p>가</p>"]
    assert [(r.code, r.entity_id[-6:]) for r in issues.collect()] == [("UNREADABLE_PAGE", "b.html")]


@pytest.mark.parametrize("encoding,data,codes", [
    ("utf-8", "a,b\n,\n1,\"x, y\"\n".encode(), []),
    ("utf-8", b"\xef\xbb\xbfa,b\n1,2\n", ["BOM"]),
    ("utf-8-bom", b"a,b\n1,2\n", ["BOM"]),
    ("windows-1252", "é,b\n1,2\n".encode("cp1252"), []),
    ("utf-8", b"only\n", ["ROWS"]),
    ("utf-8", (",".join("x" * 17) + "\n1\n").encode(), ["COLUMNS"]),
    ("utf-8", ("y" * 501 + ",b\n1,2\n").encode(), ["CELL"]),
])
def test_csv_rules(spark, tmp_path, encoding, data, codes):
    (tmp_path / "t.csv").write_bytes(data)
    rows, issues = readers.read_csv_strict(spark, str(tmp_path), encoding)
    assert [r.code for r in issues.collect()] == codes
    if data.startswith(b"a,b\n,"):
        assert sorted(tuple(r.cells) for r in rows.collect()) == [("1", "x, y"), ("a", "b")]


def test_keyed_xml(spark, tmp_path):
    body = '<t><country location="K" category="coop" code="kr"><quota>50</quota></country><country location="K" category="wh" code="kr"><quota>10,239</quota></country></t>'
    (tmp_path / "a.xml").write_text(body)
    (tmp_path / "b.xml").write_text("<!DOCTYPE t>" + body)
    got = {r.file.rsplit("/", 1)[-1]: (r.refused, r.matches, r.value) for r in readers.read_keyed_xml(
        spark, str(tmp_path), "country", {"location": "K", "category": "wh", "code": "kr"}, "quota").collect()}
    assert got == {"a.xml": (False, 1, "10,239"), "b.xml": (True, 1, None)}
    none = readers.read_keyed_xml(spark, str(tmp_path / "a.xml"), "country", {"category": "zz"}, "quota").first()
    assert (none.matches, none.value) == (0, None)


def test_roles_leave_mail_out(spark):
    df = spark.createDataFrame([(1, "https://a", "https://a"), (2, "https://a", "mailto:x@y.z"), (3, "https://b", None)], "id int, s string, c string")
    got = sorted((r.url, r.owner_id, r.roles) for r in readers.url_roles(df, "id", "s", "c").collect())
    assert got == [("https://a", 1, ["contact", "source"]), ("https://a", 2, ["source"]), ("https://b", 3, ["source"])]


def test_report_order_and_staleness(spark, tmp_path):
    a = spark.createDataFrame([(2, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert writers.same_output(a, a.orderBy("k"), ["k", "v"]).first().same
    assert not writers.same_output(a, b, ["k", "v"]).first().same
    assert sorted((r.k, r.v, r.side) for r in writers.stale_rows(a, b, ["k", "v"]).collect()) == [(2, "x", "left"), (2, "z", "right")]
    writers.publish_partitions(a.withColumn("country", F.lit("NZ")), str(tmp_path / "out"), F.lit("2026-07-19"))
    meta = spark.read.parquet(str(tmp_path / "out/meta")).first()
    assert (meta.country, meta["count"], meta.schema_version) == ("NZ", 2, 1)


def test_csv_keeps_every_cell(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(30))
    (tmp_path / "t.csv").write_text(wide + '\n"a ""b"", c",,"two\nlines",end\n,x\n', encoding="utf-8")
    rows, issues = readers.read_csv_strict(spark, str(tmp_path), "utf-8")
    assert sorted(map(tuple, (r.cells for r in rows.collect()))) == sorted(
        [tuple(wide.split(",")), ('a "b", c', "", "two\nlines", "end"), ("", "x")]
    )
    assert [(r.code, r.actual) for r in issues.collect()] == [("COLUMNS", "30")]


def test_last_named_link_wins(spark):
    page = "<!-- <a href='/gone'>n</a> --><a href='/one'>n</a><a href=/two>n</a>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    names = spark.createDataFrame([("n",), ("lost",)], "name string")
    links = readers.named_links(df, "id", "html", names)
    assert [tuple(r) for r in links.collect()] == [(1, "n", "/two")]
    assert [r.entity_id for r in readers.missing_names(links, names).collect()] == ["lost"]
