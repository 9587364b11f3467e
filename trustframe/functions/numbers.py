"""Number tokens, amounts, percentages and durations found in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustframe import policies as P

DECIMAL = "decimal(38,18)"
#: A number token; most places of a text are ruled out before anything is looked at around them.
NUMBER = r"(?=\d)" + P.NUMBER_TOKEN


def canonical_decimal(value: Column) -> Column:
    """Shortest plain text of a number: no exponent, no trailing zeros, no negative zero."""
    text = value.cast(DECIMAL).cast("string")
    plain = F.when(
        F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    ).otherwise(text)
    zero = value.cast(DECIMAL) == F.lit(0)
    return F.when(zero, F.lit("0")).otherwise(plain)


def canonical_token(token: Column) -> Column:
    """Shortest plain text of ``1,234.5``, ``12k`` or ``3m`` at any length: the point is shifted as text."""
    suffix = F.lower(F.right(token, F.lit(1)))
    shift = F.when(suffix == "k", F.lit(3)).when(suffix == "m", F.lit(6)).otherwise(F.lit(0))
    digits = F.translate(token, ",kKmM", "")
    whole = F.substring_index(digits, ".", 1)
    part = F.substring(digits, F.length(whole) + 2, F.length(digits))
    part = F.rpad(part, F.greatest(F.length(part), shift), F.lit("0"))
    whole = F.regexp_replace(F.concat(whole, F.substring(part, F.lit(1), shift)), r"\A0+(?=\d)", "")
    part = F.rtrim(F.substring(part, shift + 1, F.length(part)), F.lit("0"))
    # most tokens are digits alone, for which only zeros before them go
    plain = F.when(token.rlike(r"\A\d+\z"), F.regexp_replace(token, r"\A0+(?=\d)", ""))
    return plain.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))


def token_value(token: Column) -> Column:
    """Number of a token for comparisons only; its exact digits are those of ``canonical_token``."""
    return F.when(token.rlike(r"\A[\d.]+\z"), token.cast("double")).otherwise(canonical_token(token).cast("double"))


def number_tokens(text: Column) -> Column:
    """All number tokens in order, as written."""
    return F.regexp_extract_all(text, F.lit("(" + NUMBER + ")"), F.lit(1))


def tokens_in_context(text: Column, clause_note: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<token,value,left,right,clause,in_date>>``: tokens with clause and neighbourhood.

    All regular expressions run once per text (or clause) and are zipped: the neighbourhoods over the whole
    text and the token lists of its clauses have the same order because no clause break can fall
    inside a token. ``clause_note`` replaces the clause text by something computed once per clause.
    """
    # the last alternative never matches: a character beyond U+FFFF in a pattern makes Java look behind by characters, not UTF-16 units
    left = F.regexp_extract_all(text, F.lit("(?s)(?=\\d)(?<=(^.{0,7}|.{8}|(?!)\U0010FFFF))" + P.NUMBER_TOKEN), F.lit(1))
    right = F.regexp_extract_all(text, F.lit("(?s)" + NUMBER + "(?=(.{0,12}))"), F.lit(1))
    note = clause_note or (lambda c: c)
    per_clause = F.transform(
        F.split(text, P.CLAUSE_BREAK), lambda c: F.struct(number_tokens(c).alias("t"), note(c).alias("n"))
    )
    found = F.flatten(F.transform(per_clause, lambda c: F.transform(
        c["t"], lambda t: F.struct(t.alias("token"), token_value(t).alias("value"), c["n"].alias("clause"))
    )))
    # tokens inside a date span, found by marking date spans and tokens in one pass
    marked = F.regexp_replace(text, r"(?=\d)(?:(" + P.DATE_SPAN + ")|(" + P.NUMBER_TOKEN + "))", "\u0001$1\u0002$2\u0003")
    pieces = F.regexp_extract_all(marked, F.lit("(?s)\u0001([^\u0002]*)\u0002[^\u0003]*\u0003"), F.lit(1))
    in_date = F.flatten(
        F.transform(
            pieces,
            lambda d: F.when(d == "", F.array(F.lit(False))).otherwise(
                F.transform(number_tokens(d), lambda _t: F.lit(True))
            ),
        )
    )
    zipped = F.arrays_zip(found.alias("found"), left.alias("left"), right.alias("right"), in_date.alias("in_date"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            z["found"]["token"].alias("token"), z["found"]["value"].alias("value"), z["left"].alias("left"),
            z["right"].alias("right"), z["found"]["clause"].alias("clause"), z["in_date"].alias("in_date"),
        ),
    )


def single_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The captured group when the pattern occurs exactly once, else NULL."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # bound once inside the array, so the pattern is not evaluated a second time for the value
    return F.try_element_at(F.filter(F.array(found), lambda f: F.size(f) == 1), F.lit(1))[0]


def plain_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def single_number(text: Column, pattern: str, group: int = 1) -> Column:
    """Number of the one occurrence of a pattern whose group is digits, commas and a point; NULL for none or several.

    Matched once, in generated code: several numbers joined by a bar are no number.
    """
    return plain_number(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), "|"))


def _amount(pattern: str, group: int) -> Callable[[Column], Column]:
    return lambda text: single_number(text, pattern, group)


_AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
_EDGE_L = r"(?<![A-Za-z0-9])"
_EDGE_R = r"(?![A-Za-z0-9])"


def _same_days(text: Column) -> Column:
    days = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?i){_EDGE_L}([0-9][0-9,]*)\s+days?\b"), F.lit(1)), plain_number
    )
    return F.when((F.size(days) >= 2) & (F.size(F.array_distinct(days)) == 1), days[0])


def _days(text: Column) -> Column:
    return single_number(text, rf"(?i){_EDGE_L}([0-9][0-9,]*)\s+days?\b")


def _years(text: Column) -> Column:
    return single_number(text, rf"(?i){_EDGE_L}([0-9][0-9,]*)\s+years?\b")


def _days_to_months(text: Column) -> Column:
    days = _days(text)
    return F.when(days % 30 == 0, days / 30)


def _service_standard(text: Column) -> Column:
    months = single_number(text, rf"(?i){_EDGE_L}([0-9][0-9,]*)-month service standard\b")
    target = single_match(text, rf"(?i){_EDGE_L}(80%)\s+of cases\b")
    return F.when(target.isNotNull() & (months > 0), months)


def _leading_currency(text: Column) -> Column:
    token = rf"{_EDGE_L}(?:NZD|CAD|AUD) \${_AMOUNT}{_EDGE_R}"
    leads = text.rlike(r"\A(?:NZD|CAD|AUD) \$[0-9][0-9,]*(?:\.[0-9]+)?" + _EDGE_R)
    return F.when(leads, single_number(text, token))


def _embedded_percent(text: Column) -> Column:
    shape = r"\A\$([0-9]+(?:\.[0-9]+)?) per \$100 \(([0-9]+(?:\.[0-9]+)?)%\)\z"
    per_hundred = F.regexp_extract(text, shape, 1).try_cast("double")
    percent = F.regexp_extract(text, shape, 2).try_cast("double")
    return F.when(per_hundred == percent, percent)


def _percent(text: Column) -> Column:
    return single_number(text, rf"{_EDGE_L}([0-9]+(?:\.[0-9]+)?)\s*%{_EDGE_R}")


def _bare_percentage(text: Column) -> Column:
    value = F.when(text.rlike(r"\A(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"), text.try_cast("double"))
    return F.when(value.between(0, 100), value / 100)


def _whole_range(low: Column, high: Column) -> Column:
    ok = (low <= high) & (low == F.floor(low)) & (high == F.floor(high))
    return F.when(ok, F.concat(canonical_decimal(low), F.lit("-"), canonical_decimal(high)))


def _inclusive_range(text: Column) -> Column:
    english = r"(?i)\Abe between the ages of ([0-9][0-9,]*) and ([0-9][0-9,]*) \(inclusive\)\z"
    loose = (
        rf"(?iu){_EDGE_L}{_AMOUNT}\s*(?:[-–—]|\bto\b|\bà\b)\s*{_AMOUNT}{_EDGE_R}"
    )
    by_words = _whole_range(
        plain_number(F.regexp_extract(text, english, 1)), plain_number(F.regexp_extract(text, english, 2))
    )
    by_marks = _whole_range(single_number(text, loose, 1), single_number(text, loose, 2))
    return (
        F.when(text.rlike(english), by_words)
        .when(text.rlike(r"(?i)\bbetween the ages of\b"), F.lit(None).cast("string"))
        .otherwise(by_marks)
    )


def _final_range(text: Column) -> Column:
    shape = rf"{_EDGE_L}([0-9][0-9,]*)\s*[-–—]\s*([0-9][0-9,]*){_EDGE_R}"
    low = F.regexp_extract_all(text, F.lit(shape), F.lit(1))
    high = F.regexp_extract_all(text, F.lit(shape), F.lit(2))
    return F.when(F.size(low) == 2, _whole_range(plain_number(low[1]), plain_number(high[1])))


_INTEGER = r"(?<![A-Za-z0-9.])([0-9][0-9,]*)(?![A-Za-z0-9.])"
_NUMBER = rf"(?<![A-Za-z0-9.]){_AMOUNT}(?![A-Za-z0-9.])"

# Allow-listed text transforms: name -> builder. DOUBLE out, text for ranges, NULL when the text changed.
TEXT_TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "number": _amount(_NUMBER, 1),
    "integer": _amount(_INTEGER, 1),
    "currency-to-number": _amount(rf"(?i){_EDGE_L}(?:(?:NZD|CAD|AUD)\s*)?\$?\s*{_AMOUNT}{_EDGE_R}", 1),
    "single-iso-amount-to-number": _amount(rf"{_EDGE_L}(?:NZD|CAD|AUD)\s*\$?\s*{_AMOUNT}{_EDGE_R}", 1),
    "single-iso-currency-to-number": _amount(rf"{_EDGE_L}(?:NZD|CAD|AUD)\s+\${_AMOUNT}{_EDGE_R}", 1),
    "single-dollar-amount-to-number": _amount(rf"(?<![A-Za-z0-9$])\${_AMOUNT}{_EDGE_R}", 1),
    "single-hourly-dollar-amount-to-number": _amount(
        rf"(?i)(?<![A-Za-z0-9$])\${_AMOUNT}\s+(?:per|an)\s+hour{_EDGE_R}", 1
    ),
    "leading-currency-to-number": _leading_currency,
    "percent-to-decimal": lambda text: _percent(text) / 100,
    "embedded-percent": _embedded_percent,
    "embedded-percent-to-decimal": lambda text: _embedded_percent(text) / 100,
    "percentage-number-to-decimal": _bare_percentage,
    "identical-duration-days": _same_days,
    "single-duration-days": _days,
    "single-duration-days-to-months": _days_to_months,
    "single-duration-years": _years,
    "single-duration-years-to-months": lambda text: _years(text) * 12,
    "duration-months": _amount(rf"(?i){_EDGE_L}{_AMOUNT}\s+(?:months?|mois)\b", 1),
    "duration-weeks": _amount(rf"(?i){_EDGE_L}{_AMOUNT}\s+weeks?\b", 1),
    "service-standard-months": _service_standard,
    "inclusive-range": _inclusive_range,
    "final-inclusive-range": _final_range,
}


def text_transform(name: str, text: Column) -> Column:
    """Apply one allow-listed transform to white-space-normalised text."""
    if name not in TEXT_TRANSFORMS:
        raise ValueError(f"unknown text transform {name!r}")
    return TEXT_TRANSFORMS[name](F.trim(F.regexp_replace(text, r"\s+", " ")))


def typed_cell(cell: Column, value_type: str, null_token: str = "") -> Column:
    """Exact cell token of a declared type as DOUBLE; NULL when malformed (or the declared null token)."""
    clean = F.replace(F.trim(F.regexp_replace(cell, r"\s+", " ")), F.lit(","), F.lit(""))
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"
    if value_type == "percent-to-decimal":
        shape = rf"\A({number})\s*%\z"
        return F.when(clean.rlike(shape), F.regexp_extract(clean, shape, 1).try_cast("double") / 100)
    shape = r"\A[+-]?\d+\z" if value_type == "integer" else rf"\A{number}\z"
    value = F.when(clean.rlike(shape), clean.try_cast("double"))
    if value_type == "nullable-number":
        return F.when(clean == null_token, F.lit(None).cast("double")).otherwise(value)
    return value


def round_half_up(value: Column) -> Column:
    """Rounds .5 towards positive infinity, as ``floor(x + 0.5)``."""
    return F.floor(value + F.lit(0.5))


def within(actual: Column, expected: Column, tolerance: float) -> Column:
    close = F.abs(actual - expected) <= F.lit(tolerance)
    return F.coalesce(close & ~F.isnan(actual), actual.isNull() & expected.isNull())
