"""Strict dates, zoned timestamps and cohort labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
)


def strict_date(text: Column) -> Column:
    """Real calendar day in canonical ``YYYY-MM-DD`` text, else NULL."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def _by_parts(day: Column, month_name: Column, year: Column) -> Column:
    # position in a literal list and a plain cast: much cheaper than a formatter with month names
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month_name))
    iso = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month > 0, iso.try_cast("date"))


def english_date(text: Column) -> Column:
    """``d MMMM yyyy`` with an English month name, any letter case."""
    part = F.split(text, " ")
    return F.when(text.rlike(r"\A\d{1,2} [A-Za-z]+ \d{4}\z"), _by_parts(*[F.get(part, F.lit(i)) for i in (0, 1, 2)]))


def long_date(text: Column) -> Column:
    """``MMMM d, yyyy``."""
    part = F.split(F.translate(text, ",", ""), " ")
    return F.when(text.rlike(r"\A[A-Z][a-z]+ \d{1,2}, \d{4}\z"), _by_parts(*[F.get(part, F.lit(i)) for i in (1, 0, 2)]))


def zoned_timestamp(text: Column) -> Column:
    """ISO timestamp that names its zone; NULL when the zone is missing or the text is no timestamp."""
    shaped = F.when(
        text.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})\z"), text
    )
    return F.try_to_timestamp(shaped)


def cohort_date(label: Column) -> Column:
    """Start day of a dated cohort label; NULL for undated labels.

    Income-year labels start on 1 July and must be consecutive years;
    ``From 1 July 2026`` and ``If you apply on or after April 30, 2026`` name the day.
    """
    text = F.trim(F.regexp_replace(label, r"\s+", " "))
    year = (
        r"\A(?:Working holiday maker tax rates|Tax rates for resident taxpayers for) "
        r"(\d{4})[-–](\d{2})(?: year of income)?\z"
    )
    start = F.regexp_extract(text, year, 1).try_cast("int")
    end = F.regexp_extract(text, year, 2).try_cast("int")
    consecutive = (start + 1) % 100 == end
    return (
        F.when(F.startswith(text, F.lit("From ")), english_date(F.substr(text, F.lit(6))))
        .when(F.startswith(text, F.lit("If you apply on or after ")), long_date(F.substr(text, F.lit(26))))
        .when(consecutive, F.make_date(start, F.lit(7), F.lit(1)))
    )


def review_due(verified: Column, days: Column | int) -> Column:
    return F.date_add(verified, days)


def days_overdue(due: Column, as_of: Column) -> Column:
    return F.greatest(F.datediff(as_of, due), F.lit(0))
