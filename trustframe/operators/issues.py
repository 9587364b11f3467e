"""One issues schema for every check, and the rule runner."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_COLUMNS = ("check", "code", "entity_id", "field", "actual", "expected", "fix", "dims")


@dataclass(frozen=True)
class Rule:
    """A violation predicate. ``bad`` NULL counts as not violated."""

    code: str
    field: str
    bad: Column
    actual: Column | None = None
    expected: str | Column = ""
    fix: str = ""
    dims: dict[str, Column] = field(default_factory=dict)


def _text(value: str | Column) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value)


def run_rules(df: DataFrame, check: str, entity_id: Column, rules: Sequence[Rule]) -> DataFrame:
    """All violations of all rules: one projection and one generate, no shuffle.

    Every rule is evaluated for every row (no stop at the first failure).
    """
    hits = []
    for rule in rules:
        dims = F.create_map(*[part for k, v in rule.dims.items() for part in (F.lit(k), v.cast("string"))])
        hits.append(
            F.when(
                F.coalesce(rule.bad, F.lit(False)),
                F.struct(
                    F.lit(rule.code).alias("code"),
                    F.lit(rule.field).alias("field"),
                    (F.lit(None) if rule.actual is None else rule.actual).cast("string").alias("actual"),
                    _text(rule.expected).alias("expected"),
                    F.lit(rule.fix).alias("fix"),
                    dims.cast("map<string,string>").alias("dims"),
                ),
            )
        )
    found = df.select(entity_id.cast("string").alias("entity_id"), F.explode(F.array_compact(F.array(*hits))).alias("i"))
    return found.select(
        F.lit(check).alias("check"), "i.code", "entity_id", "i.field", "i.actual", "i.expected", "i.fix", "i.dims"
    )


def issue_rows(df: DataFrame, check: str, code: str, entity_id: Column, field_name: str | Column,
               actual: Column | None = None, expected: str | Column = "", fix: str = "",
               dims: dict[str, Column] | None = None) -> DataFrame:
    """Every row of ``df`` becomes one issue (for anti joins and group rules)."""
    pairs = [part for k, v in (dims or {}).items() for part in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(check).alias("check"),
        F.lit(code).alias("code"),
        entity_id.cast("string").alias("entity_id"),
        _text(field_name).alias("field"),
        (F.lit(None) if actual is None else actual).cast("string").alias("actual"),
        _text(expected).alias("expected"),
        F.lit(fix).alias("fix"),
        F.create_map(*pairs).cast("map<string,string>").alias("dims"),
    )


def union_issues(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("check", "code").agg(F.count(F.lit(1)).alias("issues"))


def valid_rows(df: DataFrame, entity_id: str, issues: DataFrame) -> DataFrame:
    """Rows without any issue (duplicates and audits work on these)."""
    bad = issues.select(F.col("entity_id").alias("__bad")).distinct()
    return df.join(bad, df[entity_id].cast("string") == bad["__bad"], "left_anti")
