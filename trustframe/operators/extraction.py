"""Extractors by name: declared look-ups in pages, CSV, XML and JSON documents give (unit, value) for every declaration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions.dates import cohort_date
from trustframe.functions.numbers import canonical_decimal
from trustframe.functions.selectors import SHARES, select_value
from trustframe.functions.variants import children, json_type, scalar_text
from trustframe.operators.pages import page_elements, table_rows
from trustframe.session import cut_lineage
from trustframe.sources.readers import record_cells

#: What an extractor gives: hits is the number of places that fit, value that of the one place.
FOUND = ["spec_id", "hits", "value", "value_type"]


def _param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def _one(specs: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(spec_id, value) -> FOUND; every declaration has a row."""
    counted = hits.groupBy("spec_id").agg(F.count(F.lit(1)).alias("hits"), F.min("value").alias("value"))
    joined = specs.select("spec_id").join(counted, "spec_id", "left")
    return joined.select("spec_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("value")).alias("value"), F.lit("string").alias("value_type"))


def _definition(specs: DataFrame, elements: DataFrame) -> DataFrame:
    named = specs.select("spec_id", F.col("document").alias("page"), _param("section").alias("section"), _param("label").alias("label"))
    return _one(specs, elements.filter("tag = 'dd'").join(named, ["page", "section", "label"]).select("spec_id", F.col("text").alias("value")))


def _labelled(specs: DataFrame, elements: DataFrame) -> DataFrame:
    named = specs.select("spec_id", F.col("document").alias("page"), _param("outer").alias("outer_section"), _param("label").alias("section"))
    return _one(specs, elements.filter("tag in ('p', 'li')").join(named, ["page", "outer_section", "section"]).select("spec_id", F.col("text").alias("value")))


def _section_text(specs: DataFrame, elements: DataFrame) -> DataFrame:
    named = specs.select("spec_id", F.col("document").alias("page"), _param("heading").alias("section_h3"), _param("anchor").alias("text"))
    return _one(specs, elements.filter("tag in ('p', 'li')").join(named, ["page", "section_h3", "text"]).select("spec_id", F.col("text").alias("value")))


def _declared_tables(specs: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declarations with the tables of their header row, all visible rows): the header is declared as cells parted by ``|``."""
    rows = cut_lineage(table_rows(elements).withColumn("row_text", F.array_join("cells", "|")))
    named = specs.select("spec_id", F.col("document").alias("page"), _param("headers").alias("row_text"), _param("section").alias("wanted"),
                         _param("row").alias("row_label"), _param("column").alias("column"))
    heads = named.join(rows.select("page", "table_no", "row_no", "section", "row_text"), ["page", "row_text"])
    heads = heads.groupBy("spec_id", "page", "table_no", "wanted", "row_label", "column", F.col("row_text").alias("headers")).agg(
        F.count(F.lit(1)).alias("header_rows"), F.min("row_no").alias("header_at"), F.max("section").alias("section"))
    return heads.filter("header_rows = 1"), rows


def _cell_of(headers: Column, column: Column, cells: Column) -> Column:
    names = F.split(headers, r"\|")
    at = F.array_position(names, column).cast("int")
    return F.when((at > 0) & (F.size(names) == F.size(cells)), F.get(cells, at - 1))


def _table_record(specs: DataFrame, elements: DataFrame) -> DataFrame:
    """The cell of a labelled row; a table of the same header with a later dated section makes the declared cohort outdated."""
    heads, rows = _declared_tables(specs, elements)
    newest = heads.groupBy("spec_id").agg(F.max(cohort_date(F.col("section"))).alias("newest"))
    chosen = heads.filter(F.col("section") == F.col("wanted")).join(newest, "spec_id").filter(~F.coalesce(F.col("newest") > cohort_date(F.col("wanted")), F.lit(False)))
    body = chosen.join(rows.select("page", "table_no", "row_no", "cells"), ["page", "table_no"]).filter(
        (F.col("row_no") > F.col("header_at")) & (F.get("cells", F.lit(0)) == F.col("row_label")))
    return _one(specs, body.select("spec_id", _cell_of(F.col("headers"), F.col("column"), F.col("cells")).alias("value")))


def _table_column(specs: DataFrame, elements: DataFrame) -> DataFrame:
    """A whole column of the one table with the header row, as a JSON array of its cells; a page's table is one group."""
    heads, rows = _declared_tables(specs, elements)
    body = heads.join(rows.select("page", "table_no", "row_no", "cells"), ["page", "table_no"]).filter(F.col("row_no") > F.col("header_at"))
    cell = F.struct("row_no", _cell_of(F.col("headers"), F.col("column"), F.col("cells")).alias("c"))
    column = F.to_json(F.transform(F.array_sort(F.collect_list(cell)), lambda x: F.coalesce(x["c"], F.lit(""))))
    made = _one(specs, body.groupBy("spec_id", "table_no").agg(column.alias("value")))
    return made.withColumn("value_type", F.lit("array"))


def _found(value: Column, hits: Column) -> Column:
    """FOUND of a VARIANT, without its id."""
    return F.struct(hits.cast("bigint").alias("hits"), F.coalesce(scalar_text(value), F.when(json_type(value).isin("object", "array"), F.to_json(value))).alias("value"), json_type(value).alias("value_type"))


def _selected(document: Column, path: Column) -> Column:
    picked = select_value(document, path)
    return _found(picked["value"], F.when(picked["problem"].isNull(), F.lit(1)).otherwise(F.coalesce(picked["hits"], F.lit(0))))


def _xml_selector(body: Column, params: Column) -> Column:
    """A selector path over the elements (children by name, attributes as ``_name``); declarations of a document type are refused."""
    safe = F.when(~body.rlike(r"(?i)<!DOCTYPE|<!ENTITY"), body)
    return _selected(F.from_xml(safe, "variant"), F.try_element_at(params, F.lit("selector")))


def _json_selector(body: Column, params: Column) -> Column:
    return _selected(F.try_parse_json(body), F.try_element_at(params, F.lit("selector")))


def _json_pointer(body: Column, params: Column) -> Column:
    """A JSON pointer, given per row."""
    pointer = F.try_element_at(params, F.lit("pointer"))
    parts = F.when(pointer == "/", F.array().cast("array<string>")).otherwise(F.slice(F.split(pointer, "/"), 2, 1 << 30))

    def step(now: Column, part: Column) -> Column:
        members, items = children(now)
        name = F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        item = F.when(part.rlike(r"\A(?:0|[1-9][0-9]*)\z"), F.get(items, part.try_cast("int")))
        # the value of a key that is there may be null
        return F.when(members.isNotNull(), F.coalesce(F.try_element_at(members, name), F.when(F.map_contains_key(members, name), F.parse_json(F.lit("null"))))).otherwise(item)

    node = F.aggregate(F.when(F.startswith(pointer, F.lit("/")), parts), F.try_parse_json(body), step)
    return _found(node, F.when(node.isNotNull(), F.lit(1)).otherwise(F.lit(0)))


def _csv_cell(body: Column, params: Column) -> Column:
    """The cell in ``column`` of the one record whose cell in ``key_column`` is ``key``; the first record names the columns."""
    clean = F.regexp_replace(body, r"\A﻿", "")
    records = F.filter(F.regexp_extract_all(clean, F.lit(r'((?:"[^"]*+"|[^"\r\n])++)'), F.lit(1)), lambda r: r != "")
    cells = F.transform(records, record_cells)
    head = F.get(cells, F.lit(0))
    at = lambda name: F.array_position(head, F.try_element_at(params, F.lit(name))).cast("int") - 1
    hits = F.filter(F.slice(cells, 2, 1 << 30), lambda r: F.get(r, at("key_column")) == F.try_element_at(params, F.lit("key")))
    value = F.when((F.size(hits) == 1) & (at("column") >= 0), F.get(F.get(hits, F.lit(0)), at("column")))
    return F.struct(F.coalesce(F.size(hits), F.lit(0)).cast("bigint").alias("hits"), value.alias("value"), F.lit("string").alias("value_type"))


def _inside(held: DataFrame, read: Callable[[Column, Column], Column]) -> DataFrame:
    """held(body, own) -> FOUND, each document's declarations in its row."""
    made = F.transform("own", lambda s: F.struct(s["spec_id"].alias("spec_id"), read(F.col("body"), s["params"]).alias("r")))
    return held.select(F.explode(made).alias("x")).select("x.spec_id", "x.r.hits", "x.r.value", "x.r.value_type")


#: name -> (declarations, visible elements) -> FOUND
PAGE_EXTRACTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "html-definition": _definition, "html-labelled-values": _labelled, "html-section-text": _section_text,
    "html-table-record": _table_record, "html-table": _table_column,
}
#: name -> (body, params) -> FOUND, inside the row of the document
BODY_EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {
    "csv-cell": _csv_cell, "xml-selector": _xml_selector, "json-selector": _json_selector, "json-pointer": _json_pointer,
}


def extract_values(specs: DataFrame, documents: DataFrame) -> DataFrame:
    """specs(spec_id, document, mode, params), documents(document, body) -> (spec_id, mode, unit, value, value_type, hits, problem).

    Each mode is a plan that only its declarations enter; pages are parsed once for all of them. ``params`` is a map of
    text; ``unit`` is taken from it, and ``value_type`` ``number`` asks for a plain number as the value.
    Problems: UNKNOWN_MODE, NO_DOCUMENT, NOT_ONE (hits other than 1), NOT_A_NUMBER. ``spec_id`` and ``document`` must be unique.
    """
    specs = cut_lineage(specs.select("spec_id", "document", "mode", "params"))
    parts = []
    paged = specs.filter(F.col("mode").isin(*PAGE_EXTRACTORS))
    pages = documents.join(paged.select("document").distinct(), "document", "left_semi")
    elements = cut_lineage(page_elements(pages, "document", "body").filter("not hidden"))
    for mode, run in PAGE_EXTRACTORS.items():
        parts.append(run(specs.filter(F.col("mode") == mode), elements).select(*FOUND))
    # declarations of one document are dealt to shares, so that its text is not copied for each of them
    one = F.struct("spec_id", "mode", "params")
    dealt = specs.filter(F.col("mode").isin(*BODY_EXTRACTORS)).groupBy("document", "mode", F.pmod(F.xxhash64("spec_id"), F.lit(SHARES)).alias("share")).agg(F.collect_list(one).alias("own"))
    held = dealt.join(documents.select("document", "body"), "document")
    for mode, read in BODY_EXTRACTORS.items():
        parts.append(_inside(held.filter(F.col("mode") == mode), read))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    known = documents.select("document", F.lit(True).alias("known")).distinct()
    every = specs.join(found, "spec_id", "left").join(known, "document", "left")
    number = canonical_decimal(F.col("value").try_cast("decimal(38,18)"))
    wants_number = F.coalesce(_param("value_type") == "number", F.lit(False))
    one_hit = F.coalesce(F.col("hits") == 1, F.lit(False))
    problem = (
        F.when(~F.col("mode").isin(*PAGE_EXTRACTORS, *BODY_EXTRACTORS), "UNKNOWN_MODE").when(F.col("known").isNull(), "NO_DOCUMENT")
        .when(~one_hit, "NOT_ONE").when(wants_number & number.isNull(), "NOT_A_NUMBER")
    )
    return every.select(
        "spec_id", "mode", F.when(problem.isNull(), _param("unit")).alias("unit"),
        F.when(problem.isNull(), F.when(wants_number, number).otherwise(F.col("value"))).alias("value"),
        F.when(problem.isNull(), F.when(wants_number, F.lit("number")).otherwise(F.col("value_type"))).alias("value_type"),
        F.coalesce("hits", F.lit(0)).alias("hits"), problem.alias("problem"),
    )
