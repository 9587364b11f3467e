"""Strict readers: registries, pages, CSV, keyed XML, JSON records, register rows, links, locators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustframe.functions.dates import english_date
from trustframe.functions.text import collapse_ws
from trustframe.functions.variants import json_type, pointer_to_path
from trustframe.operators.issues import Rule, run_rules
from trustframe.operators.pages import page_links


def read_registry(spark: SparkSession, path: str, array_field: str) -> DataFrame:
    """Registry documents to rows: (file, ord, row VARIANT, row_json).

    ``try_parse_json`` is the strict parser: NaN, Infinity and trailing text are no JSON. ``ord`` is
    the array position, which decides who is first among duplicates.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc")
    )
    items = docs.select("file", F.try_variant_get("doc", pointer_to_path("/" + array_field), "variant").alias("items"))
    rows = items.lateralJoin(spark.tvf.variant_explode(F.col("items").outer()).toDF("ord", "k", "row"))
    return rows.select("file", F.col("ord").cast("bigint").alias("ord"), "row", F.to_json("row").alias("row_json"))


def registry_root_issues(spark: SparkSession, path: str, root_keys: Sequence[str], array_field: str,
                         schema_version: int = 1) -> DataFrame:
    """Problems of the documents themselves: not JSON, wrong keys, wrong version, no array."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("doc")
    )
    keys = F.json_object_keys(F.to_json("doc"))
    wanted = F.array(*map(F.lit, root_keys))
    items = F.try_variant_get("doc", pointer_to_path("/" + array_field), "variant")
    version = F.try_variant_get("doc", "$.schemaVersion", "variant")
    version_ok = (json_type(version) == "number") & (F.try_variant_get("doc", "$.schemaVersion", "double") == schema_version)
    return run_rules(docs, "registry", F.col("file"), [
        Rule("NOT_JSON", "root", F.col("doc").isNull(), None, "strict JSON"),
        Rule("ROOT_KEYS", "root", F.col("doc").isNotNull() & F.coalesce(F.size(F.array_except(wanted, keys)) > 0, F.lit(True)), F.array_join(keys, ","), ",".join(root_keys)),
        Rule("VERSION", "schemaVersion", F.col("doc").isNotNull() & ~F.coalesce(version_ok, F.lit(False)), None, str(schema_version)),
        Rule("NO_ARRAY", array_field, F.col("doc").isNotNull() & ~json_type(items).eqNullSafe(F.lit("array")), json_type(items), "array"),
    ])


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Page files as text: (pages: page, html), (issues for files that are no UTF-8)."""
    raw = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("page"), F.try_validate_utf8(F.col("content").cast("string")).alias("html")
    )
    issues = run_rules(raw, "pages", F.col("page"), [Rule("UNREADABLE_PAGE", "encoding", F.col("html").isNull(), None, "UTF-8")])
    return raw.filter(F.col("html").isNotNull()), issues


CSV_CHARSETS = {"utf-8": "UTF-8", "utf-8-bom": "UTF-8", "windows-1252": "ISO-8859-1"}
# windows-1252 is Latin-1 except for these bytes; bytes it leaves undefined stay control characters
_C1 = {bytes([b]).decode("latin-1"): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_FROM, _TO = (("".join(part) for part in zip(*[(k, v) for k, v in _C1.items() if v])))
_UNDEFINED = "[" + "".join(k for k, v in _C1.items() if not v) + "]"


def record_cells(raw: Column) -> Column:
    """Cells of one CSV record as written: commas inside quotes do not separate, doubled quotes are one."""
    line = F.concat(F.lit(","), F.regexp_replace(raw, r"\A\ufeff|\r?\n?\z", ""))
    cells = F.regexp_extract_all(line, F.lit(r',((?s:"[^"]*+(?:""[^"]*+)*+")?[^,]*+)'), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.rlike(r'(?s)\A".*"\z'), inner(c)).otherwise(c))


def read_csv_strict(spark: SparkSession, path: str, encoding: str, max_columns: int = 16, max_cell: int = 500,
                    rows_between: tuple[int, int] = (2, 256)) -> tuple[DataFrame, DataFrame]:
    """Small reviewed CSV files: (rows: file, cells), (issues per file).

    Encoding is one of utf-8, utf-8-bom, windows-1252 and the byte-order mark must match it. Blank
    rows are dropped. Bounds are rules: nothing is cut off, a row has as many cells as its record.
    """
    if encoding not in CSV_CHARSETS:
        raise ValueError(f"unsupported encoding {encoding!r}")
    # a record of more than one cell does not fit the schema of one: the reader then hands over its whole text
    schema = "first string, record string"
    rows = spark.read.csv(
        path, schema=schema, encoding=CSV_CHARSETS[encoding], header=False, multiLine=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord="record", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"',
        enforceSchema=True, maxCharsPerColumn=-1,
    ).select(
        F.col("_metadata.file_path").alias("file"),
        F.coalesce(record_cells(F.col("record")), F.array(F.col("first"))).alias("__c"),
    )
    used = F.coalesce(F.array_max(F.transform("__c", lambda c, i: F.when(c.isNotNull() & (c != ""), i + 1))), F.lit(0))
    latin = encoding == "windows-1252"
    cells = F.transform(
        F.slice("__c", 1, used),
        lambda c: F.translate(F.coalesce(c, F.lit("")), _FROM, _TO) if latin else F.coalesce(c, F.lit("")),
    )
    undecodable = F.exists("__c", lambda c: F.coalesce(c.rlike(_UNDEFINED if latin else "\ufffd"), F.lit(False)))
    rows = rows.withColumn("used", used)
    sized = rows.filter("used > 0").groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.max("used").alias("columns"),
        F.max(F.array_max(F.transform("__c", lambda c: F.length(c)))).alias("longest"),
        F.bool_or(undecodable).alias("undecodable"),
    )
    heads = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("__f"), (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom"),
    )
    low, high = rows_between
    joined = heads.join(sized, F.regexp_replace("__f", r"^file:/+", "/") == F.regexp_replace("file", r"^file:/+", "/"), "left")
    n = F.coalesce("rows", F.lit(0))
    issues = run_rules(joined, "csv", F.col("__f"), [
        Rule("BOM", "encoding", F.col("bom") != (encoding == "utf-8-bom"), F.col("bom"), encoding),
        Rule("UNDECODABLE", "encoding", F.col("undecodable"), None, encoding),
        Rule("ROWS", "rows", ~n.between(low, high), n, f"{low}..{high}"),
        Rule("COLUMNS", "columns", F.col("columns") > max_columns, F.col("columns"), f"<= {max_columns}"),
        Rule("CELL", "cell", F.col("longest") > max_cell, F.col("longest"), f"<= {max_cell}"),
    ])
    return rows.filter("used > 0").select("file", cells.alias("cells")), issues


def read_keyed_xml(spark: SparkSession, path: str, row_tag: str, match: Mapping[str, str], child: str) -> DataFrame:
    """The one ``row_tag`` element per file whose attributes equal ``match``: (file, matches, value).

    A document type or entity declaration anywhere in the file refuses the file (``refused``).
    """
    schema = T.StructType(
        [T.StructField(f"_{a}", T.StringType()) for a in match] + [T.StructField(child, T.ArrayType(T.StringType()))]
    )
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).select(
        F.col("_metadata.file_path").alias("file"), "*"
    )
    hit = F.lit(True)
    for attr, value in match.items():
        hit = hit & (F.col(f"_{attr}") == value)
    counted = rows.groupBy("file").agg(
        F.count_if(hit).alias("matches"), F.min(F.when(hit & (F.size(child) == 1), F.trim(F.col(child)[0]))).alias("__v")
    )
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").rlike(r"(?i)<!DOCTYPE|<!ENTITY").alias("refused")
    )
    ok = ~F.col("refused") & (F.col("matches") == 1)
    return docs.join(counted, "file", "left").select(
        "file", "refused", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(ok, F.col("__v")).alias("value")
    )


def json_record(df: DataFrame, keys: Sequence[str], json_text: str, array_pointer: str, match: Mapping[str, str],
                value_pointer: str) -> DataFrame:
    """Value of the one array record with the given fields, per document: (keys, matches, value)."""
    spark = df.sparkSession
    docs = df.select(*keys, F.try_parse_json(json_text).alias("__d"))
    arr = docs.select(*keys, F.try_variant_get("__d", pointer_to_path(array_pointer), "variant").alias("__a"))
    recs = arr.lateralJoin(spark.tvf.variant_explode_outer(F.col("__a").outer()).toDF("__i", "__k", "__r"))
    hit = F.lit(True)
    for field, wanted in match.items():
        hit = hit & (F.try_variant_get("__r", pointer_to_path("/" + field), "string") == wanted)
    value = F.try_variant_get("__r", pointer_to_path(value_pointer), "string")
    out = recs.groupBy(*keys).agg(F.count_if(hit).alias("matches"), F.min(F.when(hit, value)).alias("__v"))
    return out.select(*keys, "matches", F.when(F.col("matches") == 1, F.col("__v")).alias("value"))


def json_pointer_record(json_text: Column, pointer: str) -> Column:
    """struct<unit,value> when the pointer gives an object with exactly these two keys, else NULL."""
    node = F.try_variant_get(F.try_parse_json(json_text), pointer_to_path(pointer), "variant")
    keys = F.array_sort(F.json_object_keys(F.to_json(node)))
    exact = (json_type(node) == "object") & (keys == F.array(F.lit("unit"), F.lit("value")))
    record = F.struct(
        F.try_variant_get(node, "$.unit", "string").alias("unit"), F.try_variant_get(node, "$.value", "string").alias("value")
    )
    return F.when(exact, record)


FIELD_LIST = "array<struct<Title:string,Value:string>>"


def unnest_field_list(df: DataFrame, record_id: str, title: str, field_list: str) -> DataFrame:
    """Register rows whose fields are a JSON list of title and value: one flat row per record."""
    fields = F.from_json(field_list, FIELD_LIST)

    def field(name: str) -> Column:
        # the first field of that title
        return F.try_element_at(F.filter(fields, lambda f: f["Title"] == name), F.lit(1))["Value"]

    point = F.split(field("Location"), ",")
    pair = F.size(point) == 2
    return df.select(
        F.col(record_id).cast("string").alias("record_id"), collapse_ws(F.col(title)).alias("name"),
        collapse_ws(field("Physical address")).alias("address"),
        F.when(pair, F.trim(point[0]).try_cast("double")).alias("lat"),
        F.when(pair, F.trim(point[1]).try_cast("double")).alias("lng"),
        english_date(field("Status expiry date")).alias("effective_to"), F.trim(field("Website")).alias("website"),
    )


def named_links(pages: DataFrame, page: str, html: str, names: DataFrame) -> DataFrame:
    """Links whose anchor name is allow-listed: (page, name, href); the last link of a name in a page wins."""
    links = page_links(pages, page, html).join(names.select("name").distinct(), "name", "left_semi")
    return links.groupBy(page, "name").agg(F.max_by("href", "seq").alias("href"))


def missing_names(links: DataFrame, names: DataFrame) -> DataFrame:
    """Issues for declared names that no page links."""
    lost = names.select("name").distinct().join(links.select("name").distinct(), "name", "left_anti")
    return run_rules(lost, "links", F.col("name"), [Rule("NAME_WITHOUT_LINK", "name", F.lit(True), F.col("name"), "one link")])


def url_roles(df: DataFrame, owner: str, source_url: str, contact_url: str) -> DataFrame:
    """Fetchable locators with owner and roles: (url, owner_id, roles). Mail addresses are left out.

    One row per (url, owner): a popular url never becomes one huge array.
    """
    pairs = df.select(
        F.col(owner).alias("owner_id"),
        F.explode(
            F.array(
                F.struct(F.col(source_url).alias("url"), F.lit("source").alias("role")),
                F.struct(F.col(contact_url).alias("url"), F.lit("contact").alias("role")),
            )
        ).alias("p"),
    ).select("owner_id", "p.*")
    web = pairs.filter(F.col("url").isNotNull() & (F.col("url") != "") & ~F.startswith(F.col("url"), F.lit("mailto:")))
    agg = web.groupBy("url", "owner_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return agg


def url_summary(roles: DataFrame) -> DataFrame:
    """Per url: number of owners, first owner, and whether it is used as source or contact."""
    return roles.groupBy("url").agg(
        F.countDistinct("owner_id").alias("owners"), F.min("owner_id").alias("first_owner"),
        F.bool_or(F.array_contains("roles", "source")).alias("is_source"),
        F.bool_or(F.array_contains("roles", "contact")).alias("is_contact"),
    )
