"""Numeric facts in pages and whether each is marked, exempted or uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import classify, fingerprints, numbers, text
from trustframe.operators.issues import issue_rows, union_issues
from trustframe.operators.ranking import duplicate_rows, last_write_wins
from trustframe.operators.reconcile import subset_gaps
from trustframe.operators.rules import blank
from trustframe.functions.dates import strict_date


def facts_in(body: Column, categories: Column) -> Column:
    """Countable number tokens of a text in context; ``clause`` has those of ``categories`` that the token's clause gives it."""
    tokens = numbers.tokens_in_context(body, lambda clause: classify.clause_categories(clause, categories))
    return F.filter(tokens, lambda t: classify.countable(t["value"], t["in_date"]))


def numeric_facts(df: DataFrame, body: str, own_mark: str | None = None) -> DataFrame:
    """(…, category, numbers) for every category with at least one number; ``body`` is normalised text.

    Categories come from the wording of the text; a mark adds the categories of its identifier, and
    for those the clause needs no keyword. A category's patterns run only where the text or the mark has it.
    """
    text_has = classify.text_categories(F.col(body))
    by_id = F.array().cast("array<string>")
    if own_mark is not None:
        by_id = F.coalesce(classify.id_categories(F.col(own_mark)), by_id)
    staged = df.filter(F.col(body).rlike(r"\d")).withColumns({"__w": text_has, "__i": by_id})
    some = (F.size("__w") > 0) | (F.size("__i") > 0)
    staged = staged.withColumn("__f", F.when(some, facts_in(F.col(body), F.col("__w"))))

    def facts_of(category: Column) -> Column:
        marked = F.array_contains("__i", category)
        kept = F.filter(
            "__f",
            lambda f: (marked | F.array_contains(f["clause"], category))
            & classify.fits_category(category, f["value"], f["left"], f["right"]),
        )
        found = F.array_distinct(F.transform(kept, lambda f: numbers.canonical_token(f["token"])))
        return F.struct(category.alias("category"), found.alias("numbers"))

    # the numbers are made and tested inside one array: a filter above them would be pushed down with a copy of its own
    rows = F.filter(F.transform(F.array_union("__w", "__i"), facts_of), lambda r: F.size(r["numbers"]) > 0)
    return staged.select(*df.columns, F.inline(rows))


def page_candidates(elements: DataFrame) -> DataFrame:
    """Fact candidates of page elements: (page, selector, fingerprint, category, numbers, text, line, directly_marked)."""
    wanted = ~F.col("ignored") & (F.col("tag").isin(*P.SEMANTIC_TAGS) | F.col("own_mark").isNotNull())
    body = text.collapse_ws(text.nfkc(F.col("text")))
    base = elements.filter(wanted).select(
        "page", "selector", "line", "seq", F.col("marked").alias("directly_marked"), "own_mark", body.alias("text")
    ).filter(F.col("text") != "")
    facts = numeric_facts(base, "text", own_mark="own_mark")
    out = facts.select(
        "page", "selector",
        fingerprints.fact_fingerprint(F.col("category"), F.col("text"), normalized=True).alias("fingerprint"),
        "category", "numbers", "text", "line", "directly_marked", "seq",
    )
    return last_write_wins(out, ["selector", "fingerprint", "category"], "seq").drop("seq")


def marked_facts(candidates: DataFrame) -> DataFrame:
    """Distinct (page, category, number) that a mark vouches for."""
    return candidates.filter("directly_marked").select(
        "page", "category", F.explode("numbers").alias("number")
    ).distinct()


def coverage_outcomes(candidates: DataFrame, exemptions: DataFrame, as_of: Column) -> DataFrame:
    """Candidates with their outcome: marked, exempted or uncovered; ``known_exemption`` may be expired.

    A candidate is marked directly, or when all its numbers are marked elsewhere on the same page in
    the same category.
    """
    keyed = candidates.withColumn("candidate_id", F.sha2(F.concat_ws("\0", "selector", "fingerprint", "category"), 256))
    unmarked = keyed.filter("not directly_marked")
    gaps = subset_gaps(unmarked, marked_facts(candidates), ["page", "category"], "candidate_id", "numbers", "number")
    first = exemptions.groupBy("selector", "fingerprint").agg(F.max("expires_at").alias("expires_at"))
    joined = keyed.join(gaps, "candidate_id", "left").join(first, ["selector", "fingerprint"], "left")
    covered = F.col("directly_marked") | F.col("missing").isNull()
    outcome = (
        F.when(covered, F.lit("marked")).when(F.col("expires_at") >= as_of, F.lit("exempted")).otherwise(F.lit("uncovered"))
    )
    return joined.select(
        *candidates.columns, outcome.alias("outcome"),
        (~covered & F.col("expires_at").isNotNull()).alias("known_exemption"),
    )


def coverage_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def exemption_issues(exemptions: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """INVALID, DUPLICATE, EXPIRED and ORPHAN exemptions.

    ``exemptions``: ord, selector, fingerprint, reason, owner, expires_at (text). An expired exemption
    still counts as known for its candidate.
    """
    fields_bad = F.lit(False)
    for name in ("selector", "fingerprint", "reason", "owner", "expires_at"):
        fields_bad = fields_bad | blank(F.col(name))
    day = strict_date(F.col("expires_at"))
    invalid = fields_bad | day.isNull() | ~F.coalesce(F.col("fingerprint").rlike(r"\Asha256:[0-9a-f]{20}\z"), F.lit(False))
    good = exemptions.filter(~invalid)
    repeated = duplicate_rows(good, ["selector", "fingerprint"], "ord")
    firsts = good.join(repeated.select("ord"), "ord", "left_anti")
    needed = outcomes.filter(F.col("outcome") != "marked").select("selector", "fingerprint").distinct()
    orphan = firsts.join(needed, ["selector", "fingerprint"], "left_anti")
    expired = firsts.filter(day < as_of)

    def rows(df: DataFrame, code: str, name: str, expected: str) -> DataFrame:
        return issue_rows(df, "coverage", code, F.col("selector"), name, F.col(name), expected)

    return union_issues([
        rows(exemptions.filter(invalid), "INVALID_EXEMPTION", "fingerprint", "complete exemption"),
        rows(repeated, "DUPLICATE_EXEMPTION", "fingerprint", "unique selector and fingerprint"),
        rows(expired, "EXPIRED_EXEMPTION", "expires_at", "day not passed"),
        rows(orphan, "ORPHAN_EXEMPTION", "fingerprint", "an uncovered candidate"),
    ])
