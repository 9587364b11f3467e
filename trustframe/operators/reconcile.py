"""Reconciliation joins, cardinality checks and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import urls
from trustframe.functions.variants import pointer_ancestors
from trustframe.operators.blocks import BLOCKS, in_blocks, same_blocks
from trustframe.operators.issues import Rule, run_rules
from trustframe.operators.ranking import join_back
from trustframe.session import spread


def _rename(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns])


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner (declared but not found, scope without mapping, orphans)."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Per key, the compared fields that differ (NULL-safe): ``field, left_value, right_value``.

    ``right`` has one row per key; keys without a partner are not reported here (see ``unmatched``).
    """
    r = _rename(right, [*keys, *compare], "__r_")
    cond = None
    for k in keys:
        part = left[k] == r[f"__r_{k}"]
        cond = part if cond is None else cond & part
    joined = left.join(r, cond, "inner")
    fields = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(c).eqNullSafe(F.col(f"__r_{c}")),
                    F.struct(
                        F.lit(c).alias("field"),
                        F.col(c).cast("string").alias("left_value"),
                        F.col(f"__r_{c}").cast("string").alias("right_value"),
                    ),
                )
                for c in compare
            ]
        )
    )
    return joined.select(*keys, F.explode(fields).alias("d")).select(*keys, "d.*")


def full_reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ORPHAN (left only), MISSING (right only), DUPLICATE (left more than once) per key, else MATCHED.

    Both sides are counted per key first, so a hot key costs one row in the join.
    """
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_rows"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_rows"))
    both = l.join(r, list(keys), "full_outer")
    status = (
        F.when(F.col("right_rows").isNull(), F.lit("ORPHAN"))
        .when(F.col("left_rows").isNull(), F.lit("MISSING"))
        .when(F.col("left_rows") > 1, F.lit("DUPLICATE"))
        .otherwise(F.lit("MATCHED"))
    )
    return both.select(
        *keys, status.alias("outcome"),
        F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"),
    )


def match_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each left key with how many right rows it has (0 included): the cardinality join."""
    counts = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    return (
        left.select(*keys).distinct().join(counts, list(keys), "left")
        .select(*keys, F.coalesce("__m", F.lit(0)).alias("matches"))
    )


def not_exactly_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return match_counts(left, right, keys).filter(F.col("matches") != 1)


def unreferenced(targets: DataFrame, references: Sequence[DataFrame], key: str) -> DataFrame:
    """Targets that none of the reference tables names."""
    named = references[0].select(key)
    for ref in references[1:]:
        named = named.unionByName(ref.select(key))
    return targets.join(named.distinct(), [key], "left_anti")


def set_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Multiset difference both ways with ``side`` and ``copies``; empty when the tables are equal."""
    signed = left.select(*columns, F.lit(1).alias("__s")).unionByName(right.select(*columns, F.lit(-1).alias("__s")))
    diff = signed.groupBy(*columns).agg(F.sum("__s").alias("__d")).filter(F.col("__d") != 0)
    return diff.select(
        *columns, F.when(F.col("__d") > 0, F.lit("left")).otherwise(F.lit("right")).alias("side"),
        F.abs("__d").alias("copies"),
    )


def subset_gaps(candidates: DataFrame, allowed: DataFrame, keys: Sequence[str], id_col: str,
                items: str, item: str) -> DataFrame:
    """Candidates with an item outside the allowed items of the same keys; ``missing`` counts them."""
    rows = candidates.select(id_col, *keys, F.explode(F.array_distinct(items)).alias(item))
    absent = rows.join(allowed.select(*keys, item).distinct(), [*keys, item], "left_anti")
    return absent.groupBy(id_col).agg(F.count(F.lit(1)).alias("missing"))


def mapping_overlaps(mappings: DataFrame, target: str, path: str, owner: str) -> DataFrame:
    """Mappings whose path lies under, or equals, a path mapped by another owner of the same target.

    Paths are looked up by their ancestors (equi join). Owners are reduced to (count, min, max) per
    path first, so equal paths never produce all pairs.
    """
    per_path = mappings.groupBy(F.col(target).alias("__t"), F.col(path).alias("__p")).agg(
        F.countDistinct(owner).alias("__n"), F.min(owner).alias("__lo"), F.max(owner).alias("__hi")
    )
    up = mappings.select(target, path, owner, F.explode(pointer_ancestors(F.col(path))).alias("__a"))
    hit = up.join(per_path, (F.col(target) == F.col("__t")) & (F.col("__a") == F.col("__p")))
    other = F.when(F.col("__lo") != F.col(owner), F.col("__lo")).when(F.col("__hi") != F.col(owner), F.col("__hi"))
    return (
        hit.withColumn("__other", other).filter(F.col("__other").isNotNull())
        .groupBy(target, path, owner)
        .agg(F.min("__other").alias("other_owner"), F.min("__p").alias("covering_path"))
    )


def leaf_owners(leaves: DataFrame, mappings: DataFrame, target: str, leaf: str, path: str) -> DataFrame:
    """Each leaf with how many mappings cover it (0, 1, many)."""
    per_path = mappings.groupBy(F.col(target).alias("__t"), F.col(path).alias("__p")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    up = leaves.select(target, leaf).distinct().select(
        target, leaf, F.explode(pointer_ancestors(F.col(leaf))).alias("__a")
    )
    joined = up.join(per_path, (F.col(target) == F.col("__t")) & (F.col("__a") == F.col("__p")), "left")
    return joined.groupBy(target, leaf).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("owners"))


def component_owners(leaves: DataFrame, components: DataFrame, target: str, leaf: str, path: str,
                     component: str) -> DataFrame:
    """Leaves that are not owned by exactly one declared component of their target."""
    declared = components.select(target, path, component).distinct()
    return leaf_owners(leaves, declared, target, leaf, path).filter(F.col("owners") != 1)


def allowed_hosts(df: DataFrame, host: str, allow: DataFrame, key: str | None = None) -> DataFrame:
    """Rows whose host is allow-listed for its key: suffix explosion turns it into an equi join.

    ``allow`` has ``domain`` (and ``key``). Only distinct hosts are exploded; equal rows stay apart.
    """
    keys = [key] if key else []
    hosts = df.select(*keys, host).distinct().withColumn("domain", F.explode(urls.host_suffixes(F.col(host))))
    good = hosts.join(allow.select(*keys, "domain"), [*keys, "domain"], "left_semi").select(*keys, host).distinct()
    return df.join(good, [*keys, host], "left_semi").select(*df.columns)


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str, low: str, high: str,
               width: float, how: str = "inner") -> DataFrame:
    """Points inside ranges of the same keys, as an equi join on buckets.

    ``how``: inner or left_anti. Buckets are ``width`` times a power of two; a range takes the power that
    is no smaller than itself, so it lies in at most two buckets, whatever its length. The powers that
    occur (some sixty at most for doubles of one unit) are read first: a point asks one bucket of each.
    Full buckets are cut into blocks.
    """
    span = F.greatest((F.col(high) - F.col(low)).cast("double") / width, F.lit(1.0))
    leveled = ranges.filter(F.col(low) <= F.col(high)).withColumn("__lv", F.ceil(F.log2(span)).cast("int"))
    levels = sorted(row[0] for row in leveled.select("__lv").distinct().collect())

    def bucket(at: Column, level: Column) -> Column:
        return F.floor(at.cast("double") / (F.pow(F.lit(2.0), level) * width))

    first, last = (bucket(F.col(c), F.col("__lv")) for c in (low, high))
    r = leveled.withColumn("__b", F.explode(F.array_distinct(F.array(first, last))))
    renamed = r.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], "__lv", "__b", *[c for c in ranges.columns if c not in keys]
    )
    inside = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"__r_{k}"))
    drop = ["__pl", "__pb", "__lv", "__b", *[f"__r_{k}" for k in keys]]
    if how == "left_anti":
        for level in levels:
            asked = bucket(F.col(value), F.lit(level))
            points = points.join(renamed.filter(F.col("__lv") == level), (asked == F.col("__b")) & inside, "left_anti")
        return points
    powers = F.array(*map(F.lit, levels)).cast("array<int>")
    asked = spread(points).withColumn("__pl", F.explode(powers)).withColumn("__pb", bucket(F.col(value), F.col("__pl")))
    p, r = in_blocks(
        asked, renamed, [*keys, "__pl", "__pb"], [*[f"__r_{k}" for k in keys], "__lv", "__b"],
        points.columns, [low, high, *[c for c in ranges.columns if c not in (*keys, low, high)]],
    )
    met = (F.col("__pl") == F.col("__lv")) & (F.col("__pb") == F.col("__b")) & same_blocks()
    return p.join(r, met & inside, how).select("a.*", "b.*").drop(*drop, *BLOCKS)


def evidence_window_problems(evidence_verified: Column, evidence_from: Column, evidence_to: Column,
                             current_as_of: Column, review_days: Column, output_verified: Column,
                             output_from: Column, as_of: Column) -> Column:
    """Codes of the window rules an evidence row breaks for the output it supports."""
    checks = {
        "PREDATES_OUTPUT": evidence_verified < output_verified,
        "FUTURE": evidence_verified > as_of,
        "STALE": F.datediff(as_of, evidence_verified) > review_days,
        "CURRENT_AFTER_VERIFIED": current_as_of > evidence_verified,
        "STARTS_AFTER_OUTPUT": evidence_from > output_from,
        "ENDS_BEFORE_OUTPUT": evidence_to < output_from,
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()])
    )


def override_upsert(base: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` where an override row exists (an override NULL keeps the base value)."""
    o = overrides.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    joined = base.join(o, F.col(key) == F.col("__k"), "left")
    kept = [F.coalesce(F.col(f"__o_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*kept, F.col("__k").isNotNull().alias("overridden"))


def unknown_overrides(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Issues for overrides of keys that the base table lacks."""
    lost = overrides.join(base.select(key), key, "left_anti")
    return run_rules(lost, "override", F.col(key), [Rule("UNKNOWN_KEY", key, F.lit(True), F.col(key), "a key of the base table")])


def group_completeness(members: DataFrame, group: str, member: str, bound: DataFrame,
                       minimum: int = 2) -> DataFrame:
    """Groups that are too small, or have members without a binding: (group, members, unbound, code)."""
    m = members.select(group, member).distinct()
    b = bound.select(F.col(member).alias("__b")).distinct()
    joined = m.join(b, F.col(member) == F.col("__b"), "left")
    agg = joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("__b").isNull()).alias("unbound")
    )
    code = F.when(F.col("members") < minimum, F.lit("ORPHAN_GROUP")).when(F.col("unbound") > 0, F.lit("UNBOUND_MEMBER"))
    return agg.withColumn("code", code).filter(F.col("code").isNotNull())


def owner_mismatches(df: DataFrame, owner: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose edition attributes differ from those of the edition table (or name no edition)."""
    o = owner.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    joined = df.join(o, F.col(key) == F.col("__k"), "left")
    differs = F.col("__k").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return joined.filter(differs).drop("__k")


def prune_retired(state: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """State rows whose key is still in the current batch."""
    return state.join(current.select(key).distinct(), [key], "left_semi")


def audit_differences(declared: DataFrame, computed: DataFrame, metric: str = "metric", value: str = "n") -> DataFrame:
    """Metrics whose declared and computed values differ, either side may be missing."""
    d = declared.select(F.col(metric), F.col(value).alias("declared"))
    c = computed.select(F.col(metric), F.col(value).alias("computed"))
    joined = d.join(c, [metric], "full_outer")
    return joined.filter(~F.col("declared").eqNullSafe(F.col("computed")))


def over_cap(df: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Keys with more rows than their cap. The cap is a rule: no row is hidden."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > cap)


def weighted_sum(components: DataFrame, keys: Sequence[str], value: Column, multiplier: Column,
                 unit: Column, expected_unit: Column) -> DataFrame:
    """Sum of value x multiplier per key; NULL unless every component has its expected unit."""
    agg = components.groupBy(*keys).agg(
        F.sum(value * multiplier).alias("__s"),
        F.bool_and(F.coalesce(unit == expected_unit, F.lit(False))).alias("units_agree"),
        F.count(F.lit(1)).alias("components"),
    )
    return agg.select(*keys, "components", "units_agree", F.when(F.col("units_agree"), F.col("__s")).alias("total"))


def sum_same_unit(df: DataFrame, keys: Sequence[str], value: Column, unit: Column) -> DataFrame:
    """Sum per key when all inputs share one unit, else NULL."""
    agg = df.groupBy(*keys).agg(
        F.sum(value).alias("__s"), F.min(unit).alias("__u0"), F.max(unit).alias("__u1"), F.count(unit).alias("__nu"),
        F.count(F.lit(1)).alias("inputs"),
    )
    same = (F.col("__u0") == F.col("__u1")) & (F.col("__nu") == F.col("inputs"))
    return agg.select(*keys, "inputs", F.when(same, F.col("__u0")).alias("unit"), F.when(same, F.col("__s")).alias("total"))


def status_summary(df: DataFrame, status: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts per status with zeros for statuses that do not occur: (keys, status, n)."""
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(status) == v).alias(f"__{i}") for i, v in enumerate(values)])
    pairs = F.array(
        *[F.struct(F.lit(v).alias("status"), F.col(f"__{i}").alias("n")) for i, v in enumerate(values)]
    )
    return counted.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.status", "s.n")


