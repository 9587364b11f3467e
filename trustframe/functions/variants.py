"""JSON values as VARIANT: types, pointers, leaf rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions.numbers import canonical_decimal


def json_type(value: Column) -> Column:
    """null, boolean, number, string, array or object; NULL for a missing value."""
    names = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    # one look at the value: the schema text up to its first bracket names the type
    head = F.substring_index(F.schema_of_variant(value), "<", 1)
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(lookup, head), F.lit("number")))


def scalar_text(value: Column) -> Column:
    """Comparable text of a scalar: numbers canonical, so 1 equals 1.0 but true never equals 1."""
    as_text = F.try_variant_get(value, "$", "string")
    number = canonical_decimal(F.try_variant_get(value, "$", "decimal(38,18)"))
    return F.when(json_type(value) == "number", F.coalesce(number, as_text)).otherwise(as_text)


def pointer_to_path(pointer: str) -> str:
    """Fixed JSON pointer (``/a/0/b``, ``~1`` ``~0`` escapes) to a variant path (``$["a"][0]["b"]``)."""
    if pointer == "/":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError("pointer must start with '/'")
    out = "$"
    for part in pointer[1:].split("/"):
        if part == "":
            raise ValueError("pointer has an empty segment")
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out


def pointer_ancestors(pointer: Column) -> Column:
    """``/a/b`` -> [``/``, ``/a``, ``/a/b``]: turns 'path covers path' into an equi join."""
    parts = F.filter(F.split(pointer, "/"), lambda p: p != "")
    longer = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.concat(F.array(F.lit("/")), longer)


def children(value: Column) -> tuple[Column, Column]:
    """An object's members as a map and an array's items as an array; NULL where the value is something else."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    items = F.try_variant_get(value, "$", "array<variant>")
    return members, items


def _walk(df: DataFrame, value: str, keep: list[str], max_depth: int, start: Column, step: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """One row per leaf: ``keep`` + (__p, __leaf, __open); ``step(path, key, position)`` is a child's path.

    A chain of generators without a shuffle. A leaf moves from ``__open`` to ``__leaf`` at the first generator that finds no
    child in it, and the later ones pass it by without a look at it.
    """
    spark = df.sparkSession
    out = df.select(*keep, start.alias("__p"), F.lit(None).cast("variant").alias("__leaf"), F.col(value).alias("__open"))
    for _ in range(max_depth):
        child = spark.tvf.variant_explode_outer(F.col("__open").outer()).toDF("__pos", "__key", "__child")
        out = out.lateralJoin(child).select(
            *keep, F.when(F.col("__pos").isNull(), F.col("__p")).otherwise(step(F.col("__p"), F.col("__key"), F.col("__pos"))).alias("__p"),
            F.when(F.col("__pos").isNull(), F.coalesce("__leaf", "__open")).alias("__leaf"), F.col("__child").alias("__open"),
        )
    return out


def explode_leaves(df: DataFrame, value: str, keep: list[str], max_depth: int = P.MAX_POINTER_DEPTH) -> DataFrame:
    """One row per leaf: ``keep`` + (pointer, leaf_type, leaf_value); empty containers are leaves.

    A container still open after ``max_depth`` levels comes out with type ``too-deep`` instead of being lost.
    """

    def pointer(path: Column, key: Column, at: Column) -> Column:
        escaped = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        return F.concat(path, F.lit("/"), F.coalesce(escaped, at.cast("string")))

    out = _walk(df, value, keep, max_depth, F.lit(""), pointer)
    out = out.select(*keep, "__p", F.coalesce("__open", "__leaf").alias("__v"), F.col("__open").isNotNull().alias("__last"))
    out = out.withColumn("__kind", json_type(F.col("__v")))
    inner = F.col("__kind").isin("object", "array")
    text = F.when(inner, F.to_json(F.col("__v")))
    return out.select(
        *keep,
        F.when(F.col("__p") == "", F.lit("/")).otherwise(F.col("__p")).alias("pointer"),
        F.when(F.col("__last") & inner & ~text.isin("{}", "[]"), F.lit("too-deep")).otherwise(F.col("__kind")).alias("leaf_type"),
        F.when(inner, text).otherwise(scalar_text(F.col("__v"))).alias("leaf_value"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


#: Between the steps of a canonical path; keys hold none, or they are told apart by its escape.
_SEP, _ESC = "\x01", "\x02"


def canonical_documents(df: DataFrame, value: str, keep: list[str], max_depth: int = P.MAX_POINTER_DEPTH) -> DataFrame:
    """``keep`` + canonical: each document rebuilt with keys in code point order and canonical numbers, so that equal
    nested values have equal texts (1.0 is 1, true is not). A repeated ``keep`` stays one document; a document
    deeper than ``max_depth`` and a NULL one have NULL.

    Documents are rebuilt from their leaves in one pass: sorted by path, each leaf closes the containers that the
    one before has left and opens its own. A group is the leaves of one document, so its size is that of a row.
    """

    def path(before: Column, key: Column, at: Column) -> Column:
        clean = F.replace(F.replace(key, F.lit(_ESC), F.lit(_ESC + _ESC)), F.lit(_SEP), F.lit(_ESC + "s"))
        return F.concat(before, F.lit(_SEP), F.when(key.isNull(), F.concat(F.lit("i"), F.lpad(at.cast("string"), 10, "0"))).otherwise(F.concat(F.lit("k"), clean)))

    leaves = _walk(df, value, keep, max_depth, F.lit(""), path).select(*keep, "__p", F.coalesce("__open", "__leaf").alias("__v"), F.col("__open").isNotNull().alias("__last"))
    leaves = leaves.withColumn("__kind", json_type(F.col("__v")))
    text = (
        F.when(F.col("__kind").isin("object", "array"), F.to_json(F.col("__v")))
        .when(F.col("__kind") == "null", F.lit("null"))
        .when(F.col("__kind") == "string", _quoted(F.try_variant_get(F.col("__v"), "$", "string")))
        .otherwise(scalar_text(F.col("__v")))
    )
    deep = F.col("__last") & F.col("__kind").isin("object", "array") & ~text.isin("{}", "[]")
    rows = leaves.select(*keep, F.slice(F.split("__p", _SEP), 2, 1 << 30).alias("p"), text.alias("t"), deep.alias("deep"))
    docs = rows.groupBy(*keep).agg(F.sort_array(F.array_distinct(F.collect_list(F.struct("p", "t")))).alias("__l"), F.bool_or("deep").alias("__deep"))

    def shared(a: Column, b: Column) -> Column:
        """Number of leading steps that two paths have in common."""
        places = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
        return F.coalesce(F.array_min(F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i >= F.least(F.size(a), F.size(b))))), F.lit(0))

    def is_key(step: Column) -> Column:
        return F.startswith(step, F.lit("k"))

    def label(step: Column) -> Column:
        key = F.replace(F.replace(F.substr(step, F.lit(2)), F.lit(_ESC + "s"), F.lit(_SEP)), F.lit(_ESC + _ESC), F.lit(_ESC))
        return F.when(is_key(step), F.concat(_quoted(key), F.lit(":"))).otherwise(F.lit(""))

    def closed(steps: Column) -> Column:
        return F.array_join(F.transform(F.reverse(steps), lambda x: F.when(is_key(x), F.lit("}")).otherwise(F.lit("]"))), "")

    def opened(steps: Column) -> Column:
        return F.array_join(F.transform(steps, lambda x: F.concat(F.when(is_key(x), F.lit("{")).otherwise(F.lit("[")), label(x))), "")

    def piece(leaf: Column, i: Column) -> Column:
        last = F.get(F.col("__l"), i - 1)["p"]
        same = shared(last, leaf["p"])
        rest = lambda p: F.slice(p, same + 2, F.greatest(F.size(p) - same - 1, F.lit(0)))
        later = F.concat(closed(rest(last)), F.lit(","), label(F.get(leaf["p"], same)), opened(rest(leaf["p"])))
        return F.concat(F.when(i == 0, opened(leaf["p"])).otherwise(later), leaf["t"])

    body = F.array_join(F.transform(F.col("__l"), piece), "")
    end = closed(F.element_at("__l", -1)["p"])
    return docs.select(*keep, F.when(~F.col("__deep"), F.concat(body, end)).alias("canonical"))


def nested_differences(actual: DataFrame, expected: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Leaves (``keys``, pointer, leaf_type, leaf_value) of ``expected`` that ``actual`` lacks or that differ by more than the tolerance.

    Numbers compare within ``tolerance``; other leaves, types included, must be equal. More leaves of ``actual`` are no difference.
    The join is a merge: a plan's estimate does not count the leaves of a document, so a broadcast would hold far more than it says.
    """
    a = actual.select(*keys, "pointer", F.col("leaf_type").alias("actual_type"), F.col("leaf_value").alias("actual_value"))
    both = expected.join(a.hint("merge"), [*keys, "pointer"], "left")
    numbers = (F.col("leaf_type") == "number") & (F.col("actual_type") == "number")
    near = F.abs(F.col("leaf_value").try_cast("double") - F.col("actual_value").try_cast("double")) <= tolerance
    same = F.col("leaf_type").eqNullSafe(F.col("actual_type")) & F.col("leaf_value").eqNullSafe(F.col("actual_value"))
    return both.filter(~F.coalesce(F.when(numbers, near).otherwise(same), F.lit(False))).select(
        *keys, "pointer", F.col("leaf_value").alias("expected_value"), "actual_value")
