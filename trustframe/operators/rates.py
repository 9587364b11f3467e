"""Progressive rates, caps, offsets, boundary probes and bracket rules over income tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.functions.numbers import canonical_decimal, round_half_up, within
from trustframe.operators.ranking import lagged

Brackets = Sequence[tuple[float | None, float]]


def progressive(amount: Column, brackets: Brackets, floor_at: float = 0.0) -> Column:
    """Sum over bands of (part of the amount inside the band) x rate, as one codegen expression.

    Bands that end at or below ``floor_at`` are left out and the first band kept starts there.
    """
    total = F.lit(0.0)
    lower = float(floor_at)
    for cap, rate in brackets:
        if cap is not None and cap <= floor_at:
            continue
        top = amount if cap is None else F.least(amount, F.lit(float(cap)))
        total = total + F.greatest(top - F.lit(lower), F.lit(0.0)) * F.lit(float(rate))
        lower = float(cap) if cap is not None else lower
    return total


def capped_levy(amount: Column, rate: float, cap: float) -> Column:
    return F.least(amount, F.lit(float(cap))) * F.lit(float(rate))


def progressive_by_table(df: DataFrame, amount: str, brackets: DataFrame, scope: str, out: str = "tax") -> DataFrame:
    """Progressive amount where every row names its own rate table (``scope``).

    ``brackets``: (scope, seq, cap NULL when open, rate). The bands of one table are few by meaning;
    each row carries them as an array, so rows are not multiplied by bands.
    """
    bands = brackets.groupBy(F.col(scope).alias("__s")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "cap", "rate"))).alias("__bands")
    )
    joined = df.join(bands, F.col(scope) == F.col("__s"), "left")
    start = F.struct(F.lit(0.0).alias("tax"), F.lit(0.0).alias("prev"))
    tax = F.aggregate(
        "__bands",
        start,
        lambda acc, b: F.struct(
            (
                acc["tax"]
                + F.greatest(
                    F.least(F.col(amount), F.coalesce(b["cap"], F.lit(float("inf")))) - acc["prev"], F.lit(0.0)
                )
                * b["rate"]
            ).alias("tax"),
            F.coalesce(b["cap"], F.lit(float("inf"))).alias("prev"),
        ),
        lambda acc: acc["tax"],
    )
    return joined.withColumn(out, tax).drop("__s", "__bands")


def net_pay_nz(gross: Column, rates: Mapping[str, Any]) -> dict[str, Column]:
    tax = progressive(gross, rates["brackets"])
    levy = capped_levy(gross, rates["levy"]["rate"], rates["levy"]["cap"])
    return {"tax": tax, "levy": levy, "net": round_half_up(gross - tax - levy)}


def net_pay_ca(df: DataFrame, gross: str, rates: Mapping[str, Any], provinces: Sequence[str] = ("on", "bc", "ab")) -> DataFrame:
    """Adds pension, insurance, federal, and per province ``provincial_x``, ``total_x`` and ``net_x``.

    The steps are columns of their own, so shared parts are computed once and the generated code
    stays small. Ontario adds surtax, health premium and reduction.
    """
    pen, ins, fed = rates["pension"], rates["insurance"], rates["federal"]
    zero, g = F.lit(0.0), F.col(gross)
    pensionable = F.greatest(F.least(g, F.lit(float(pen["ceiling"]))) - float(pen["exempt"]), zero)
    second = F.greatest(F.least(g, F.lit(float(pen["second_max"]))) - float(pen["second_min"]), zero)
    out = df.withColumns({
        "__base": pensionable * pen["base"], "__more": pensionable * pen["additional"],
        "__second": second * pen["second_rate"], "insurance": capped_levy(g, ins["rate"], ins["max"]),
    })
    out = out.withColumns({
        "pension": F.col("__base") + F.col("__more") + F.col("__second"),
        "__taxable": F.greatest(g - F.col("__more") - F.col("__second"), zero),
    })
    base, insurance, taxable = F.col("__base"), F.col("insurance"), F.col("__taxable")
    credits = (float(fed["personal"]) + base + insurance + F.least(g, F.lit(float(fed["employment"])))) * fed["credit_rate"]
    steps = {"federal": F.greatest(progressive(taxable, fed["brackets"]) - credits, zero)}
    for code in provinces:
        prov = rates["provinces"][code]
        lowest = prov["brackets"][0][1]
        credit = (float(prov["personal"]) + base + insurance) * lowest
        steps[f"__basic_{code}"] = F.greatest(progressive(taxable, prov["brackets"]) - credit, zero)
    out = out.withColumns(steps)
    out = out.withColumns({
        f"provincial_{code}": _ontario(F.col("__basic_on"), taxable, rates["ontario"]) if code == "on" else F.col(f"__basic_{code}")
        for code in provinces
    })
    out = out.withColumns({
        f"total_{code}": F.col("federal") + F.col(f"provincial_{code}") + F.col("pension") + F.col("insurance")
        for code in provinces
    })
    out = out.withColumns({f"net_{code}": round_half_up(g - F.col(f"total_{code}")) for code in provinces})
    return out.drop("__base", "__more", "__second", "__taxable", *[f"__basic_{c}" for c in provinces])


def _ontario(basic: Column, taxable: Column, on: Mapping[str, Any]) -> Column:
    low, high = float(on["surtax_lower"]), float(on["surtax_upper"])
    surtax = (
        F.greatest(basic - low, F.lit(0.0)) * on["surtax_lower_rate"]
        + F.greatest(basic - high, F.lit(0.0)) * on["surtax_upper_rate"]
    )
    premium = F.when(taxable <= float(on["health_zero_to"]), F.lit(0.0))
    for to, base, offset, rate, cap in on["health_tiers"]:
        amount = F.least(F.lit(float(cap)), float(base) + (taxable - float(offset)) * rate)
        premium = premium.otherwise(amount) if to is None else premium.when(taxable <= float(to), amount)
    reduction = F.least(basic, F.greatest(float(on["reduction"]) - basic, F.lit(0.0)))
    return F.greatest(basic + surtax + premium - reduction, F.lit(0.0))


def low_income_offset(gross: Column, offset: Mapping[str, float]) -> Column:
    """Full offset, then two tapers, then nothing."""
    top, full, mid = float(offset["max"]), float(offset["full_to"]), float(offset["taper1_to"])
    first = top - (gross - full) * offset["taper1_rate"]
    left = top - (mid - full) * offset["taper1_rate"]
    second = left - (gross - mid) * offset["taper2_rate"]
    return (
        F.when(gross <= full, F.lit(top)).when(gross <= mid, first)
        .when(gross <= float(offset["cut_out"]), second).otherwise(F.lit(0.0))
    )


def net_pay_au(gross: Column, mode: str, rates: Mapping[str, Any]) -> dict[str, Column]:
    """Working-holiday mode taxes the first band flat, then resident bands; resident mode applies offset and levy."""
    if mode == "whm":
        cap = float(rates["holiday"]["cap"])
        tax = capped_levy(gross, rates["holiday"]["rate"], cap) + progressive(gross, rates["brackets"], floor_at=cap)
        medicare = gross * 0.0
    elif mode == "resident":
        tax = F.greatest(
            progressive(gross, rates["brackets"]) - low_income_offset(gross, rates["offset"]), F.lit(0.0)
        )
        medicare = gross * rates["medicare"]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return {
        "tax": round_half_up(tax), "medicare": round_half_up(medicare),
        "net": round_half_up(gross - tax - medicare), "super": round_half_up(gross * rates["super"]),
        "effective_rate": F.format_string("%.1f", (tax + medicare) / gross * 100),
        "tax_exact": tax, "medicare_exact": medicare,
    }


def probe_points(df: DataFrame, threshold: str, delta: Column | float = 1.0) -> DataFrame:
    """Each threshold row three times: just below, exact, just above (``probe``, ``probe_value``)."""
    d = delta if isinstance(delta, Column) else F.lit(float(delta))
    t = F.col(threshold)
    points = F.array(
        F.struct(F.lit("just-below").alias("probe"), (t - d).alias("probe_value")),
        F.struct(F.lit("exact").alias("probe"), t.alias("probe_value")),
        F.struct(F.lit("just-above").alias("probe"), (t + d).alias("probe_value")),
    )
    return df.withColumn("__p", F.explode(points)).select(*df.columns, "__p.*")


def thresholds(target: str, rates: Mapping[str, Any]) -> list[tuple[str, float, str | None]]:
    """(boundary, threshold, mode) of every reviewed constant of a target."""
    if target == "nz":
        rows = [("income-bracket", cap, None) for cap, _ in rates["brackets"] if cap is not None]
        return rows + [("levy-cap", rates["levy"]["cap"], None)]
    if target == "ca":
        rows = [("federal-bracket", cap, "on") for cap, _ in rates["federal"]["brackets"] if cap is not None]
        for code, prov in rates["provinces"].items():
            rows += [(f"{code}-bracket", cap, code) for cap, _ in prov["brackets"] if cap is not None]
        pen = rates["pension"]
        return rows + [
            ("pension-exemption", pen["exempt"], "on"), ("insurance-cap", rates["insurance"]["max"], "on"),
            ("pension-cap", pen["ceiling"], "on"), ("second-pension-cap", pen["second_max"], "on"),
        ]
    if target == "au":
        rows = [("holiday-cap", rates["holiday"]["cap"], "whm")]
        rows += [("resident-bracket", cap, "resident") for cap, _ in rates["brackets"] if cap is not None]
        off = rates["offset"]
        return rows + [("offset-continuity", off[k], "resident") for k in ("full_to", "taper1_to", "cut_out")]
    raise ValueError(f"unknown target {target!r}")


def semantic_probes(df: DataFrame, kind: Column, low: Column, high: Column, delta: Column) -> DataFrame:
    """Probes of a declared inclusive range (4) or maximum (3): ``probe, probe_value, expected``."""
    def point(name: str, value: Column, inside: bool) -> Column:
        return F.struct(
            F.lit(name).alias("probe"), value.cast("double").alias("probe_value"), F.lit(inside).alias("expected")
        )

    in_range = F.array(
        point("just-below-min", low - delta, False), point("exact-min", low, True),
        point("exact-max", high, True), point("just-above-max", high + delta, False),
    )
    maximum = F.array(
        point("just-below", high - delta, True), point("exact", high, True), point("just-above", high + delta, False)
    )
    points = F.when(kind == "inclusive-range", in_range).when(kind == "maximum", maximum)
    return df.withColumn("__p", F.explode(points)).select(*df.columns, "__p.*")


def _codes(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(False)), F.lit(c)) for c, b in checks.items()]))


def bracket_problems(brackets: DataFrame, scope: Sequence[str], block: Column) -> DataFrame:
    """Problems of rate tables (scope, seq, cap, rate): one row per broken band and code.

    ``block`` cuts ``seq`` into ranges so that one huge table is spread over tasks.
    """
    cap, rate = F.col("cap"), F.col("rate")
    rows = lagged(brackets.select(*scope, "seq", "cap", "rate"), scope, "seq", block, {"prev_cap": "cap"})
    return rows.select(*scope, "seq", F.explode(_codes({
        "TOO_FEW_BANDS": F.col("is_first") & (F.col("group_rows") < 2),
        "NEGATIVE_RATE": rate.isNull() | F.isnan(rate) | (rate < 0),
        "LAST_NOT_OPEN": F.col("is_last") & cap.isNotNull(),
        "OPEN_NOT_LAST": ~F.col("is_last") & cap.isNull(),
        "CAP_NOT_POSITIVE": ~F.col("is_last") & (cap <= 0),
        "CAP_NOT_INCREASING": ~F.col("is_last") & (cap <= F.col("prev_cap")),
    })).alias("code"))


def contiguity_problems(ranges: DataFrame, scope: Sequence[str], block: Column) -> DataFrame:
    """Labelled ranges (scope, seq, lower, upper): start at 0, integer-contiguous, open end."""
    rows = lagged(ranges.select(*scope, "seq", "lower", "upper"), scope, "seq", block, {"prev_upper": "upper"})
    return rows.select(*scope, "seq", F.explode(_codes({
        "START_NOT_ZERO": F.col("is_first") & (F.col("lower") != 0),
        "GAP": ~F.col("is_first") & ~F.col("lower").eqNullSafe(F.col("prev_upper") + 1),
        "LAST_NOT_OPEN": F.col("is_last") & F.col("upper").isNotNull(),
    })).alias("code"))


def taper_problems(max_offset: Column, full_to: Column, taper1_to: Column, taper1_rate: Column,
                   taper2_offset: Column, cut_out: Column, taper2_rate: Column) -> Column:
    """Codes for a two-step taper whose parts do not add up (1e-9) or do not end at zero (one cent)."""
    expected = max_offset - taper1_rate * (taper1_to - full_to)
    residual = taper2_offset - taper2_rate * (cut_out - taper1_to)
    return F.array_compact(
        F.array(
            F.when(~((full_to < taper1_to) & (taper1_to < cut_out)), F.lit("THRESHOLD_ORDER")),
            F.when(F.abs(expected - taper2_offset) > 1e-9, F.lit("SECOND_OFFSET")),
            F.when(F.abs(residual) > 0.01, F.lit("CUT_OUT")),
        )
    )


def probe_mismatch(actual: Column, expected: Column, tolerance: float = 0.01) -> Column:
    return ~within(actual, expected, tolerance)


_LABEL_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def bracket_of_label(label: Column, rate_text: Column) -> Column:
    """struct<lower,upper,rate,rate_text> of a label such as ``18,201 – 45,000`` or ``Over 45,000`` and a percentage; NULL otherwise.

    ``rate_text`` keeps the written places: ``16.50%`` is ``0.1650``.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")), ",", "")
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(_LABEL_NUMBER), F.lit(1)), lambda x: x.try_cast("decimal(38,18)"))
    closed = (F.size(numbers) == 2) & clean.rlike(r"[-–—]|\bto\b")
    open_ = (F.size(numbers) == 1) & clean.rlike(r"(?i)\b(?:over|above|more)\b|\+\z")
    shape = r"(?U)\A([0-9]+)(?:\.([0-9]+))?\s*%\z"
    rate = F.trim(rate_text)
    whole, part = F.regexp_extract(rate, shape, 1), F.regexp_extract(rate, shape, 2)
    places = F.char_length(part) + 2
    digits = F.regexp_replace(F.concat(whole, part), r"\A0+", "")
    padded = F.lpad(digits, F.greatest(F.char_length(digits), places + 1), F.lit("0"))
    shifted = F.concat(F.substr(padded, F.lit(1), F.char_length(padded) - places), F.lit("."), F.substr(padded, F.char_length(padded) - places + 1))
    value = F.struct(
        F.get(numbers, F.lit(0)).alias("lower"), F.when(closed, F.get(numbers, F.lit(1))).alias("upper"),
        (shifted.try_cast("decimal(38,18)")).alias("rate"), F.when(digits == "", F.lit("0")).otherwise(shifted).alias("rate_text"),
    )
    return F.when((closed | open_) & rate.rlike(shape), value)


def labelled_brackets(rows: DataFrame, page: str = "page", row: str = "row_no", label: str = "label", rate: str = "rate") -> DataFrame:
    """Bracket tables in the labelled text rows of pages: (page, table_no, seq, lower, upper, rate, rate_text).

    Rows that are brackets and follow each other without another row between them are one table (gaps and islands by
    position). A window holds the rows of one page.
    """
    in_page = Window.partitionBy(page).orderBy(row)
    read = rows.select(page, row, bracket_of_label(F.col(label), F.col(rate)).alias("b")).withColumn("at", F.row_number().over(in_page))
    found = read.filter("b is not null")
    # the place among all rows less that among brackets is the same for neighbours
    found = found.withColumn("island", F.col("at") - F.row_number().over(in_page))
    found = found.withColumn("table_no", F.dense_rank().over(Window.partitionBy(page).orderBy("island")))
    seq = F.row_number().over(Window.partitionBy(page, "table_no").orderBy(row))
    return found.select(page, "table_no", seq.alias("seq"), "b.*")


def bracket_table_problems(tables: DataFrame, page: str = "page") -> DataFrame:
    """(page, table_no, seq, code) for tables that do not start at zero, have a gap or an overlap, or no open end."""
    own = Window.partitionBy(page, "table_no").orderBy("seq")
    before, has_before = F.lag("upper").over(own), F.lag("seq").over(own).isNotNull()
    rows = tables.select(page, "table_no", "seq", "lower", "upper", before.alias("before"), has_before.alias("has_before"), F.lead("seq").over(own).isNull().alias("is_last"))
    codes = _codes({
        "START_NOT_ZERO": ~F.col("has_before") & (F.col("lower") != 0),
        "GAP": F.col("has_before") & (F.col("lower") > F.col("before") + 1),
        "OVERLAP": F.col("has_before") & (F.col("before").isNull() | (F.col("lower") <= F.col("before"))),
        "LAST_NOT_OPEN": F.col("is_last") & F.col("upper").isNotNull(),
    })
    return rows.select(page, "table_no", "seq", F.explode(codes).alias("code"))


def serialized_tables(tables: DataFrame, page: str = "page", infinity: str = "above") -> DataFrame:
    """(page, table_no, brackets): ``upper@rate`` of every table, with the rate's written places."""
    item = F.concat(F.coalesce(canonical_decimal(F.col("upper")), F.lit(infinity)), F.lit("@"), F.col("rate_text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("t")))), lambda x: x["t"])
    return tables.groupBy(page, "table_no").agg(F.array_join(listed, ";").alias("brackets"))


def claims_against_constants(claims: DataFrame, reviewed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """claims(claim_id, assertion, value_text), reviewed(assertion, constant, brackets, percent) -> (claim_id, assertion, status).

    A claim of bracket text is parsed and compared bracket by bracket; a number is compared with the constant, times a hundred if
    ``percent``. Status: match, changed, or unasserted where nothing is reviewed for the assertion.
    """
    joined = claims.join(reviewed.withColumn("known", F.lit(True)), "assertion", "left")
    parsed = F.transform(F.split("value_text", ";"), lambda t: F.struct(
        F.when(t.rlike(r"\A(?:above|Infinity)@"), F.lit(None).cast("double")).otherwise(F.substring_index(t, "@", 1).try_cast("double")).alias("cap"),
        F.regexp_extract(t, r"\A[^@]+@([0-9]+(?:\.[0-9]+)?)\z", 1).try_cast("double").alias("rate")))
    pairs = F.zip_with(parsed, F.col("brackets"), lambda a, b: (
        (a["cap"].isNull() == b["cap"].isNull()) & F.coalesce(F.abs(a["cap"] - b["cap"]) <= tolerance, F.lit(True)) & F.coalesce(F.abs(a["rate"] - b["rate"]) <= tolerance, F.lit(False))))
    listed = (F.size(parsed) == F.size("brackets")) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))
    wanted = F.when(F.col("percent"), F.col("constant") * 100).otherwise(F.col("constant"))
    number = F.abs(F.col("value_text").try_cast("double") - wanted) <= tolerance
    same = F.when(F.col("brackets").isNotNull(), listed).otherwise(number)
    status = F.when(F.col("known").isNull(), "unasserted").when(F.coalesce(same, F.lit(False)), "match").otherwise("changed")
    return joined.select("claim_id", "assertion", status.alias("status"))
