"""Bindings of published claims to run-time values: every rule is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe import policies as P
from trustframe.functions import arrays, urls
from trustframe.functions.selectors import selector_values
from trustframe.functions.variants import children, json_type
from trustframe.operators.issues import Rule, issue_rows, run_rules, union_issues
from trustframe.operators.ranking import duplicate_rows
from trustframe.operators.reconcile import unmatched


def _value(bindings: DataFrame) -> Column:
    """The transformed value; ``brackets`` is an optional column."""
    brackets = F.col("brackets") if "brackets" in bindings.columns else None
    return arrays.transform_value(F.col("op"), F.col("numbers"), F.col("text"), F.col("factor"), brackets)


def binding_issues(bindings: DataFrame, claims: DataFrame, editions: DataFrame, scope: DataFrame) -> DataFrame:
    """All binding problems.

    ``bindings``: ord, claim_id, edition, page, runtime_path, type, unit, op, numbers, text, factor,
    runtime_url, runtime_date. ``claims``: claim_id, country, locale, pages, unit, value_type,
    value_text, source_url, verified_at. ``editions``: edition, page, country, locale.
    ``scope``: claim_id.
    """
    c = claims.select(F.col("claim_id").alias("__c"), *[F.col(x).alias(f"c_{x}") for x in claims.columns if x != "claim_id"])
    e = editions.select(F.col("edition").alias("__e"), *[F.col(x).alias(f"e_{x}") for x in ("page", "country", "locale")])
    joined = bindings.join(e, F.col("edition") == F.col("__e"), "left")
    joined = joined.join(c, F.col("claim_id") == F.col("__c"), "left")
    # columns of their own, so that several rules share one evaluation
    joined = joined.withColumns({
        "__value": _value(bindings),
        "__runtime_url": urls.normalize_source_url(F.col("runtime_url")),
        "__claim_url": urls.normalize_source_url(F.col("c_source_url")),
    })
    value = F.col("__value")
    has_claim = F.col("__c").isNotNull()
    in_edition = (
        F.col("c_country").eqNullSafe(F.col("e_country")) & F.col("c_locale").eqNullSafe(F.col("e_locale"))
        & F.coalesce(F.array_contains("c_pages", F.col("page")), F.lit(False))
    )
    rules = [
        Rule("ORPHAN_BINDING", "claim_id", ~has_claim, F.col("claim_id"), "existing claim"),
        Rule("EDITION_UNKNOWN", "edition", F.col("__e").isNull(), F.col("edition"), "supported edition"),
        Rule("EDITION_PAGE", "page", F.col("page") != F.col("e_page"), F.col("page"), F.col("e_page")),
        Rule("EDITION_OWNER", "edition", has_claim & F.col("__e").isNotNull() & ~in_edition, F.col("edition"), "claim of this edition"),
        Rule("UNIT_MISMATCH", "unit", has_claim & ~F.col("unit").eqNullSafe(F.col("c_unit")), F.col("unit"), F.col("c_unit")),
        Rule("TYPE_MISMATCH", "type", has_claim & ~F.col("type").eqNullSafe(F.col("c_value_type")), F.col("type"), F.col("c_value_type")),
        Rule("TRANSFORM_FAILED", "op", value.isNull(), F.col("op"), "applicable transform"),
        Rule("VALUE_MISMATCH", "value", has_claim & value.isNotNull() & ~value.eqNullSafe(F.col("c_value_text")), value, F.col("c_value_text")),
        Rule(
            "PROVENANCE_URL", "runtime_url",
            has_claim & F.col("runtime_url").isNotNull()
            & ~F.col("__runtime_url").eqNullSafe(F.col("__claim_url")),
            F.col("runtime_url"), F.col("c_source_url"),
        ),
        Rule(
            "PROVENANCE_DATE", "runtime_date",
            has_claim & F.col("runtime_date").isNotNull() & ~F.col("runtime_date").eqNullSafe(F.col("c_verified_at")),
            F.col("runtime_date"), F.col("c_verified_at").cast("string"),
        ),
    ]
    again = [
        issue_rows(duplicate_rows(bindings, keys, "ord"), "bindings", "DUPLICATE_BINDING", F.col("claim_id"), keys[-1], F.col("ord"))
        for keys in (["claim_id", "edition"], ["edition", "page", "runtime_path"])
    ]
    unscoped = issue_rows(unmatched(bindings, scope, ["claim_id"]), "bindings", "UNSCOPED_BINDING", F.col("claim_id"), "claim_id", F.col("claim_id"))
    unbound = issue_rows(unmatched(scope, bindings, ["claim_id"]), "bindings", "UNBOUND_CLAIM", F.col("claim_id"), "claim_id", F.col("claim_id"))
    return union_issues([run_rules(joined, "bindings", F.col("claim_id"), rules), *again, unscoped, unbound])



def boundary_sets(bindings: DataFrame) -> DataFrame:
    """Numeric boundaries of bound values: (claim_id, edition, kind, unit, values); those of ``boundary_issues`` are left out."""
    value = _value(bindings)
    kept = bindings.filter(F.col("boundary_kind").isin(*P.BOUNDARY_KINDS))
    made = kept.select("claim_id", "edition", F.col("boundary_kind").alias("kind"), "unit", arrays.boundary_values(value).alias("values"))
    return made.filter(F.size("values") > 0)


def bound_values(bindings: DataFrame, documents: DataFrame) -> DataFrame:
    """``bindings`` with what their ``runtime_path`` selects: ``numbers``, ``text``, ``brackets``, ``type``, ``path_problem``.

    ``documents``: (page, document VARIANT), the constants of each page. A number or an array of numbers gives ``numbers``, a string gives
    ``text``, an array of pairs gives ``brackets`` (cap NULL where it is not a number). Columns of these names are replaced.
    """
    base = bindings.drop("numbers", "text", "brackets", "type", "path_problem")
    found = selector_values(bindings, documents, "page", "runtime_path", "document")
    items = children(F.col("value"))[1]
    number = lambda v: F.when(json_type(v) == "number", F.try_variant_get(v, "$", "decimal(38,18)"))
    listed = F.transform(items, number)
    numbers = F.when(F.col("value_type") == "number", F.array(number(F.col("value")))).when(F.forall(listed, lambda x: x.isNotNull()), listed)
    pairs = F.transform(items, lambda v: F.struct(
        number(F.get(children(v)[1], F.lit(0))).alias("cap"), number(F.get(children(v)[1], F.lit(1))).alias("rate")))
    is_pair = F.forall(items, lambda v: F.coalesce(F.size(children(v)[1]) == 2, F.lit(False)))
    values = found.select(
        F.col("page").alias("__p"), F.col("runtime_path").alias("__r"), numbers.alias("numbers"), F.when(F.col("value_type") == "string", F.col("value_text")).alias("text"),
        F.when(is_pair & (F.size(items) > 0), pairs).alias("brackets"), F.col("value_type").alias("type"), F.col("problem").alias("path_problem"))
    joined = base.join(values, F.col("page").eqNullSafe(F.col("__p")) & F.col("runtime_path").eqNullSafe(F.col("__r")), "left")
    return joined.drop("__p", "__r")


def boundary_issues(bindings: DataFrame) -> DataFrame:
    """Bindings whose boundary cannot be used: (claim_id, edition, code): a kind that is not supported, or a value without a number."""
    value = _value(bindings)
    kind_ok = F.col("boundary_kind").isin(*P.BOUNDARY_KINDS)
    code = F.when(~kind_ok, "INVALID_KIND").when(F.coalesce(F.size(arrays.boundary_values(value)), F.lit(0)) == 0, "NO_BOUNDARY")
    return bindings.filter(F.col("boundary_kind").isNotNull()).select("claim_id", "edition", code.alias("code")).filter("code is not null")
