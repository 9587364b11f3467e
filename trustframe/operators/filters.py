"""Directory and season filters, asset and outcome contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.operators.issues import Rule, issue_rows, run_rules, union_issues
from trustframe.operators.ranking import duplicate_rows, running
from trustframe.operators.rules import blank, invalid_numeric_text, not_finite


def directory_filter(df: DataFrame, q: str = "", work_type: str = "", source: str = "", precision: str = "",
                     status: str = "") -> DataFrame:
    """All given filters at once; blank means any. ``q`` is searched in name, label, region and types.

    Columns: name, label, region, work_types, source_kind, precision, status.
    """
    out = df
    for name, wanted in (("status", status), ("source_kind", source), ("precision", precision)):
        if wanted:
            out = out.filter(F.col(name) == wanted)
    if work_type:
        out = out.filter(F.array_contains("work_types", work_type))
    needle = q.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", "name", "label", F.coalesce("region", F.lit("")), F.array_join("work_types", " ")))
        out = out.filter(F.contains(hay, F.lit(needle)))
    return out


def season_filter(df: DataFrame, month: int, months: str = "months") -> DataFrame:
    """Rows active in a month; 0 keeps all."""
    return df if month == 0 else df.filter(F.array_contains(months, month))


def asset_problems(asset: DataFrame, meta: DataFrame) -> DataFrame:
    """Published country asset against its meta rows: count, unique ids, vacancy wording.

    ``asset``: ord, country, id, vacancy_status; ``meta``: country, count.
    """
    sizes = asset.groupBy("country").agg(F.count(F.lit(1)).alias("rows"))
    both = meta.select("country", F.col("count").alias("declared")).join(sizes, "country", "full_outer")
    wrong = both.filter(~F.col("declared").eqNullSafe(F.coalesce("rows", F.lit(0).cast("bigint"))))
    return union_issues([
        issue_rows(wrong, "asset", "COUNT", F.col("country"), "count", F.col("rows"), F.col("declared").cast("string")),
        issue_rows(duplicate_rows(asset, ["country", "id"], "ord"), "asset", "DUPLICATE_ID", F.col("id"), "id", F.col("ord")),
        run_rules(asset, "asset", F.col("id"), [
            Rule("VACANCY", "vacancy_status", ~F.col("vacancy_status").eqNullSafe(F.lit("directory-only")), F.col("vacancy_status"), "directory-only"),
        ]),
    ])


def cash_ranges(rows: DataFrame, keys: list[str], order_by: list[Column], block: Column, start: str,
                low: str, high: str) -> DataFrame:
    """Running minimum and maximum cash from a starting balance, per plan and in order."""
    out = running(rows, keys, order_by, block, sums={"sum_min": F.col(low), "sum_max": F.col(high)})
    return out.withColumn("cash_min", F.col(start) + F.col("sum_min")).withColumn(
        "cash_max", F.col(start) + F.col("sum_max")
    ).drop("sum_min", "sum_max")


def plan_problems(plan: DataFrame, check: str = "plan") -> DataFrame:
    """Plan rows (case_id, ord, period, visa, act, cash, d_min, d_max, cash_min, cash_max) that break the contract."""
    rules = []
    for name in ("period", "visa", "act", "cash"):
        rules.append(Rule("EMPTY_TEXT", name, blank(F.col(name)), F.col(name), "text"))
        rules.append(Rule("NUMERIC_TEXT", name, invalid_numeric_text(F.col(name)), F.col(name), "no NaN, undefined or Infinity"))
    for name in ("d_min", "d_max"):
        rules.append(Rule("NOT_FINITE", name, not_finite(F.col(name)), F.col(name), "finite number"))
    rules.append(Rule("RANGE", "d_min", F.col("d_min") > F.col("d_max"), F.col("d_min"), "min <= max"))
    rules.append(Rule(
        "RUNNING_RANGE", "cash_min",
        not_finite(F.col("cash_min")) | not_finite(F.col("cash_max")) | (F.col("cash_min") > F.col("cash_max")),
        F.col("cash_min"), "finite, min <= max",
    ))
    return run_rules(plan, check, F.col("case_id"), rules)


def outcome_problems(outcomes: DataFrame, check: str = "outcome") -> DataFrame:
    """Outcome rows against expectations.

    Columns: case_id, primary, expected_primary, alt, expected_alt, name, duration, cost, summary,
    stage_months array<double>, warnings, min_warnings, money_text, includes array, excludes array.
    """
    rules = [
        Rule("PRIMARY", "primary", ~F.col("primary").eqNullSafe(F.col("expected_primary")), F.col("primary"), F.col("expected_primary")),
        Rule("ALT", "alt", F.col("expected_alt").isNotNull() & ~F.col("alt").eqNullSafe(F.col("expected_alt")), F.col("alt"), F.col("expected_alt")),
        Rule("WARNINGS", "warnings", F.col("warnings") < F.coalesce("min_warnings", F.lit(0)), F.col("warnings"), F.col("min_warnings").cast("string")),
        Rule("STAGES", "stage_months", F.coalesce(F.size("stage_months") < 1, F.lit(True)), None, "at least one stage"),
        Rule("MONTHS", "stage_months", F.exists("stage_months", lambda m: not_finite(m) | (m <= 0)), None, "finite months > 0"),
        Rule("MISSING_TEXT", "money_text", F.exists("includes", lambda t: ~F.contains(F.col("money_text"), t)), None, "all required text"),
        Rule("FORBIDDEN_TEXT", "money_text", F.exists("excludes", lambda t: F.contains(F.col("money_text"), t)), None, "no forbidden text"),
    ]
    for name in ("name", "duration", "cost", "summary"):
        rules.append(Rule("EMPTY_TEXT", name, blank(F.col(name)), F.col(name), "text"))
        rules.append(Rule("NUMERIC_TEXT", name, invalid_numeric_text(F.col(name)), F.col(name), "no NaN, undefined or Infinity"))
    return run_rules(outcomes, check, F.col("case_id"), rules)
