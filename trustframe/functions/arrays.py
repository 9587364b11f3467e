"""Bracket text, value transforms and boundary numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustframe.functions.numbers import canonical_decimal

RANGE = r"([+-]?\d+(?:\.\d+)?)\s*[–~〜～-]\s*([+-]?\d+(?:\.\d+)?)"


def serialize_brackets(brackets: Column, infinity: str = "above", rate_text: Callable | None = None) -> Column:
    """``array<struct<cap,rate>>`` to ``cap@rate;…;above@rate``; an open cap is NULL."""
    render = rate_text or canonical_decimal
    parts = F.transform(
        brackets,
        lambda b: F.concat(
            F.coalesce(canonical_decimal(b["cap"]), F.lit(infinity)), F.lit("@"), render(b["rate"])
        ),
    )
    return F.array_join(parts, ";")


def rate_keeping_scale(rate: Column) -> Column:
    """Rate text with one decimal padded to two (0.3 -> 0.30); whole zero stays ``0``."""
    text = canonical_decimal(rate)
    return F.when(text.rlike(r"\A-?\d+\.\d\z"), F.concat(text, F.lit("0"))).otherwise(text)


def parse_brackets(text: Column) -> Column:
    """Inverse of ``serialize_brackets``; NULL when any part is malformed."""
    number = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    shape = rf"\A(?:(?:{number}|above)@{number})(?:;(?:{number}|above)@{number})*\z"
    rows = F.transform(
        F.split(text, ";"),
        lambda part: F.struct(
            F.split_part(part, F.lit("@"), F.lit(1)).try_cast("double").alias("cap"),
            F.split_part(part, F.lit("@"), F.lit(2)).try_cast("double").alias("rate"),
        ),
    )
    return F.when(text.rlike(shape), rows)


def join_range(values: Column, separator: str = "-") -> Column:
    """Two-number array to ``low-high`` text; NULL for any other size."""
    both = F.size(values) == 2
    return F.when(both, F.array_join(F.transform(values, canonical_decimal), separator))


def extract_range(text: Column, separator: str = "-") -> Column:
    clean = F.replace(text, F.lit(","), F.lit(""))
    low = canonical_decimal(F.regexp_extract(clean, RANGE, 1).try_cast("decimal(38,18)"))
    high = canonical_decimal(F.regexp_extract(clean, RANGE, 2).try_cast("decimal(38,18)"))
    return F.when(clean.rlike(RANGE), F.concat(low, F.lit(separator), high))


def transform_value(op: Column, numbers: Column, text: Column, factor: Column, brackets: Column | None = None,
                    infinity: str = "above", keep_rate_scale: bool = False) -> Column:
    """Allow-listed value transforms, chosen per row; canonical text out, NULL when not applicable.

    ``numbers`` is the array of bound numbers, ``text`` the bound text, ``factor`` for ``multiply``,
    ``brackets`` the array of cap and rate for ``serializeBrackets``; an empty one or a NULL rate gives NULL.
    """
    serialized = F.lit(None).cast("string")
    if brackets is not None:
        sound = (F.size(brackets) > 0) & F.forall(brackets, lambda b: b["rate"].isNotNull())
        serialized = F.when(sound, serialize_brackets(brackets, infinity, rate_keeping_scale if keep_rate_scale else None))
    first = F.try_element_at(numbers, F.lit(1))
    total = F.aggregate(numbers, F.lit(0).cast("decimal(38,18)"), lambda acc, n: (acc + n).cast("decimal(38,18)"))
    product = (first * factor).cast("decimal(38,18)")
    return (
        F.when(op == "identity", F.coalesce(text, canonical_decimal(first)))
        .when(op == "multiply", canonical_decimal(product))
        .when((op == "sum") & (F.size(numbers) >= 2), canonical_decimal(total))
        .when(op == "joinRange", join_range(numbers))
        .when(op == "extractRange", extract_range(text))
        .when(op == "serializeBrackets", serialized)
    )


def boundary_values(text: Column) -> Column:
    """Numbers that bound a value: both ends of a plain range, else every number, first seen order."""
    whole = rf"\A\s*{RANGE}\s*\z"
    ends = F.array(
        canonical_decimal(F.regexp_extract(text, whole, 1).try_cast("decimal(38,18)")),
        canonical_decimal(F.regexp_extract(text, whole, 2).try_cast("decimal(38,18)")),
    )
    every = F.array_distinct(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"([+-]?\d+(?:\.\d+)?)"), F.lit(1)),
            lambda t: canonical_decimal(t.try_cast("decimal(38,18)")),
        )
    )
    return F.when(text.rlike(whole), ends).otherwise(F.array_compact(every))
