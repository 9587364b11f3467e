"""Dependency graph of derived values: levels, cycles, execution, transforms, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustframe.session import cut_lineage, release


def topological_levels(edges: DataFrame, sources: DataFrame, claim: str = "claim_id", inp: str = "input_id") -> DataFrame:
    """Level of every derived claim that can run: 1 + the highest level of its inputs.

    ``edges``: (claim, input); ``sources``: column ``id`` of inputs that are valid on their own (level 0).
    Claims absent from the result were not executed: they are in or behind a cycle, or have an input that is neither
    valid nor derived.

    An open edge says level(c) >= max(a, level(i) + b); such terms are closed under composition and maximum. Each
    round retires the edges of inputs whose level is known and, at once, sends the edges of every input that waits for
    a single other one past it, so a chain halves its steps each round and equal detours become one edge. A round
    reads open edges only; a chain of n claims takes some 2 log2(n). A term of more steps than there are claims runs in a
    circle and rests; the rounds end when no edge moves, and there is no limit on levels.
    """
    none = F.lit(None).cast(edges.schema[inp].dataType)
    rows = edges.select(F.col(claim).alias("c"), F.col(inp).alias("i")).distinct()
    known = sources.select(F.col("id").alias("i"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "i", "left")
    valid = F.col("known").isNotNull()
    # the row of a claim with no input carries the most that its known inputs ask for
    start = rows.select("c", F.when(~valid, F.col("i")).alias("i"), F.when(valid, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    table = cut_lineage(start.unionByName(start.select("c", none.alias("i"), F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))).groupBy("c", "i").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    most = table.filter(F.col("i").isNull()).count()
    done: DataFrame | None = None
    while True:
        per = table.groupBy("c").agg(F.count("i").alias("open"), F.max("i").alias("j"), F.max("a").alias("a2"), F.max(F.when(F.col("i").isNotNull(), F.col("b"))).alias("b2"))
        # of a claim with one open input, an edge that rests in a circle is passed by
        useful = (F.col("open") == 0) | (F.col("open") == 1) & (F.col("j") != F.col("c")) & (F.col("b2") <= most)
        found = cut_lineage(per.filter(useful).select(F.col("c").alias("i"), (F.col("open") == 0).alias("ready"), "j", "a2", "b2"))
        ready = found.filter("ready")
        # nothing is sent to a claim that leaves the table now
        single = found.filter("not ready").join(ready.select(F.col("i").alias("j")), "j", "left_anti")
        info = ready.unionByName(single)
        out = ready.select(F.col("i").alias(claim), F.col("a2").cast("int").alias("level"))
        done = out if done is None else done.unionByName(out)
        open_ = table.filter(F.col("i").isNotNull()).join(info, "i", "left")
        moves = F.col("ready").isNotNull() & (F.col("b") <= most)
        sent = open_.select(
            "c", F.when(~moves, F.col("i")).when(~F.col("ready"), F.col("j")).alias("i"),
            F.when(moves, F.greatest("a", F.col("a2") + F.col("b"))).otherwise(F.col("a")).alias("a"),
            F.when(moves & ~F.col("ready"), F.col("b") + F.col("b2")).otherwise(F.col("b")).alias("b"), moves.alias("moved"),
        )
        left = table.filter(F.col("i").isNull()).join(ready.select(F.col("i").alias("c")), "c", "left_anti")
        following = cut_lineage(sent.unionByName(left.select("c", "i", "a", "b", F.lit(False).alias("moved"))).groupBy("c", "i").agg(
            F.max("a").alias("a"), F.max("b").alias("b"), F.max("moved").alias("moved")))
        release(table)
        if following.filter("moved").isEmpty():
            return done
        table = following


def cyclic_claims(edges: DataFrame, claim: str = "claim_id", inp: str = "input_id") -> DataFrame:
    """Derived claims in or behind a dependency cycle (only edges between derived claims count)."""
    derived = edges.select(F.col(claim).alias("id")).distinct()
    outside = edges.select(F.col(inp).alias("id")).distinct().join(derived, "id", "left_anti")
    levels = topological_levels(edges, outside, claim, inp)
    return derived.select(F.col("id").alias(claim)).join(levels.select(claim), claim, "left_anti")


def execution_status(edges: DataFrame, official_valid: DataFrame, claim: str = "claim_id",
                     inp: str = "input_id") -> DataFrame:
    """Per claim: executed or not, its level, and how many of its inputs are unmet."""
    levels = topological_levels(edges, official_valid, claim, inp)
    met = official_valid.select(F.col("id").alias(inp)).unionByName(levels.select(F.col(claim).alias(inp))).distinct()
    unmet = edges.select(claim, inp).distinct().join(met, inp, "left_anti").groupBy(claim).agg(
        F.count(F.lit(1)).alias("unmet_inputs")
    )
    claims = edges.select(claim).distinct()
    return (
        claims.join(levels, claim, "left").join(unmet, claim, "left")
        .select(
            claim, F.col("level").isNotNull().alias("executed"), F.col("level"),
            F.coalesce("unmet_inputs", F.lit(0)).alias("unmet_inputs"),
        )
    )


def transform_outcome(transform: Column, *, total: Column, calculated: Column, points: Column,
                      serialized: Column, absent_rows: Column, expected_absent: Column,
                      constant: Column) -> Column:
    """Value text of an allow-listed lineage transform, chosen per row; NULL when it cannot run."""
    cohort_ok = absent_rows == expected_absent
    return (
        F.when(transform == "sum", total.cast("string"))
        .when(transform == "calculator-execution", calculated.cast("string"))
        .when(transform == "crs-fixed-profile", points.cast("string"))
        .when(transform == "boundary-serialization", serialized)
        .when(transform.isin("uncapped-availability", "constant-absence-zero") & cohort_ok, constant)
    )


def negative_evidence(records: DataFrame, keys: Sequence[str], in_cohort: Column, required: Sequence[Column],
                      unwanted: Column, expected_rows: int, expected_unwanted: int = 0) -> DataFrame:
    """Absence as evidence: the cohort must be exact before a count of zero means anything.

    Per key: the cohort has ``expected_rows`` rows, each required record occurs exactly once, and the
    unwanted record occurs ``expected_unwanted`` times.
    """
    aggs = [F.count_if(in_cohort).alias("cohort_rows"), F.count_if(in_cohort & unwanted).alias("unwanted_rows")]
    aggs += [F.count_if(in_cohort & r).alias(f"__r{i}") for i, r in enumerate(required)]
    out = records.groupBy(*keys).agg(*aggs)
    exact = F.col("cohort_rows") == expected_rows
    for i in range(len(required)):
        exact = exact & (F.col(f"__r{i}") == 1)
    return out.select(
        *keys, "cohort_rows", "unwanted_rows", exact.alias("cohort_exact"),
        (exact & (F.col("unwanted_rows") == expected_unwanted)).alias("holds"),
    )


def input_evidence(inputs: DataFrame, direct: DataFrame, boundary: DataFrame, claim: str = "input_id") -> DataFrame:
    """Evidence of each official input: direct (exactly one), else an equal reviewed constant, else none.

    ``direct``: (input, value_text, unit); ``boundary``: (input, value_text, unit) of serialised constants.
    """
    d = direct.groupBy(F.col(claim).alias("__d")).agg(
        F.count(F.lit(1)).alias("direct_rows"), F.min(F.struct("value_text", "unit")).alias("__dv")
    )
    b = boundary.select(
        F.col(claim).alias("__b"), F.struct("value_text", "unit").alias("__bv")
    ).groupBy("__b").agg(F.min("__bv").alias("__bv"))
    joined = inputs.join(d, F.col(claim) == F.col("__d"), "left").join(b, F.col(claim) == F.col("__b"), "left")
    mine = F.struct("value_text", "unit")
    n = F.coalesce("direct_rows", F.lit(0))
    verdict = (
        F.when((n == 1) & mine.eqNullSafe(F.col("__dv")), F.lit("direct"))
        .when(n == 1, F.lit("value-mismatch"))
        .when(n > 1, F.lit("ambiguous"))
        .when(mine.eqNullSafe(F.col("__bv")), F.lit("boundary"))
        .otherwise(F.lit("none"))
    )
    return joined.select(*inputs.columns, n.alias("direct_rows"), verdict.alias("evidence"))


def remaining_critical(claims: DataFrame, direct: DataFrame, executed: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Critical claims that are neither directly attested nor executed."""
    covered = direct.select(claim).unionByName(executed.select(claim)).distinct()
    return claims.filter(F.col("severity") == "critical").join(covered, claim, "left_anti")


def critical_scope(claims: DataFrame) -> DataFrame:
    return claims.filter((F.col("status") == "derived") & (F.col("severity") == "critical"))


def lineage_audit(scope: DataFrame, edges: DataFrame, executed: DataFrame, remaining: DataFrame,
                  claim: str = "claim_id", inp: str = "input_id") -> DataFrame:
    """(metric, n): derived, mapped, executed, distinct inputs, remaining."""
    parts = [
        ("derived", scope.select(F.countDistinct(claim).alias("n"))),
        ("mapped", edges.select(F.countDistinct(claim).alias("n"))),
        ("executed", executed.select(F.countDistinct(claim).alias("n"))),
        ("inputs", edges.select(F.countDistinct(inp).alias("n"))),
        ("remaining", remaining.select(F.countDistinct(claim).alias("n"))),
    ]
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("metric"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _steps(path: Column) -> Column:
    """``/`` -> [''], ``/a/b`` -> ['', 'a', 'b']: sorted, a path stands right before everything under it."""
    return F.when(path == "/", F.array(F.lit(""))).otherwise(F.split(path, "/"))


def interval_cover(leaves: DataFrame, paths: DataFrame, target: str, pointer: str, path: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """Which paths hold which leaves, by the preorder of a document instead of exploded ancestors.

    In sorted order the leaves under a path are one interval, so one window per target over leaves and interval ends
    gives every leaf the number of intervals open at it and, if it is one, whose. Returns (``leaves`` + owners, owner)
    and (``paths`` + leaf_count). ``tag`` numbers the paths. A target is one document, so a window holds the nodes of one row.
    """
    last = F.array(F.lit("\U0010ffff"))
    ends = paths.select(F.col(target).alias("t"), _steps(F.col(path)).alias("s"), F.col(tag).cast("decimal(38,0)").alias("g"))
    none = F.lit(None).cast("string")
    events = (
        ends.select("t", "s", F.lit(0).alias("kind"), "g", none.alias("p"))
        .unionByName(leaves.select(F.col(target).alias("t"), _steps(F.col(pointer)).alias("s"), F.lit(1).alias("kind"), F.lit(None).cast("decimal(38,0)").alias("g"), F.col(pointer).alias("p")).distinct())
        .unionByName(ends.select("t", F.concat("s", last).alias("s"), F.lit(2).alias("kind"), "g", none.alias("p")))
    )
    # all rows of one place end their sum together: starts, then the leaf, then ends
    order = Window.partitionBy("t").orderBy("s", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sign = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    run = events.select(
        "t", "kind", "g", "p", F.sum(sign).over(order).alias("owners"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order).alias("before"),
        F.sum(F.coalesce(sign * F.col("g"), F.lit(0))).over(order).alias("held"))
    at = run.filter("kind = 1").select(F.col("t").alias(target), F.col("p").alias(pointer), "owners", F.when(F.col("owners") == 1, F.col("held").cast("bigint")).alias("owner"))
    sizes = run.filter("kind <> 1").groupBy("t", "g").agg((F.max("before") - F.min("before")).alias("leaf_count")).select(F.col("g").cast("bigint").alias(tag), "leaf_count")
    return at, paths.join(sizes, tag)


def input_partition(reviewed: DataFrame, source: DataFrame, mappings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Problems of the evidence for a calculator's inputs: every reviewed leaf is owned once, with its value and unit.

    ``reviewed``: (target, pointer, leaf_type, leaf_value, unit), the leaves of each target's reviewed document;
    ``source``: (attestation, pointer, leaf_type, leaf_value, unit), the leaves that an attestation states (unit NULL: as the
    reviewed one); ``mappings``: (target, attestation, reviewed_path, expected_path); ``allowed``: (target, attestation) pairs
    that must each have a mapping. Codes: CARDINALITY (leaf with no or several owners), ORPHAN (mapping without a reviewed leaf), MISMATCH
    (value or number of leaves), UNIT, UNMAPPED. Returns (code, target, path, attestation, actual, expected).
    """
    named = cut_lineage(mappings.withColumn("tag", F.monotonically_increasing_id() + 1))
    at, sized = interval_cover(reviewed, named, "target", "pointer", "reviewed_path", "tag")
    _, stated = interval_cover(source, named, "attestation", "pointer", "expected_path", "tag")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, code: str, path: str, attestation: Column, actual: Column, expected: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), "target", F.col(path).alias("path"), attestation.alias("attestation"), actual.cast("string").alias("actual"), expected.cast("string").alias("expected"))

    at = cut_lineage(at)
    count = rows(at.filter("owners <> 1"), "CARDINALITY", "pointer", none, F.col("owners"), F.lit("1"))
    both = cut_lineage(sized.join(stated.select("tag", F.col("leaf_count").alias("stated_count")), "tag", "left"))
    orphan = rows(both.filter("leaf_count = 0"), "ORPHAN", "reviewed_path", F.col("attestation"), F.lit("0"), F.lit("a reviewed leaf"))
    sizes = F.coalesce("stated_count", F.lit(0))
    uneven = rows(both.filter((F.col("leaf_count") > 0) & (sizes != F.col("leaf_count"))), "MISMATCH", "reviewed_path", F.col("attestation"), sizes, F.col("leaf_count"))
    # the leaf that the owner states: its path, and the rest of the leaf's pointer
    owned = at.filter("owner is not null").join(named.select(F.col("tag").alias("owner"), "attestation", "reviewed_path", "expected_path"), "owner")
    root = lambda c: F.when(F.col(c) == "/", F.lit("")).otherwise(F.col(c))
    rest = F.when(F.col("pointer") == "/", F.lit("")).otherwise(F.substr("pointer", F.char_length(root("reviewed_path")) + 1))
    place = F.concat(root("expected_path"), rest)
    owned = owned.withColumn("place", F.when(place == "", F.lit("/")).otherwise(place))
    mine = reviewed.select("target", "pointer", "leaf_type", "leaf_value", "unit")
    theirs = source.select("attestation", F.col("pointer").alias("place"), F.col("leaf_type").alias("s_type"), F.col("leaf_value").alias("s_value"), F.col("unit").alias("s_unit"))
    held = owned.join(mine, ["target", "pointer"]).join(theirs, ["attestation", "place"], "left")
    same = F.col("leaf_type").eqNullSafe(F.col("s_type")) & F.col("leaf_value").eqNullSafe(F.col("s_value"))
    value = rows(held.filter(~same), "MISMATCH", "pointer", F.col("attestation"), F.col("s_value"), F.col("leaf_value"))
    unit = rows(held.filter(F.col("s_unit").isNotNull() & ~F.col("s_unit").eqNullSafe(F.col("unit"))), "UNIT", "pointer", F.col("attestation"), F.col("s_unit"), F.col("unit"))
    out = count.unionByName(orphan).unionByName(uneven).unionByName(value).unionByName(unit)
    if allowed is not None:
        lacking = allowed.join(mappings, ["target", "attestation"], "left_anti").withColumn("path", none)
        out = out.unionByName(rows(lacking, "UNMAPPED", "path", F.col("attestation"), F.lit("0"), F.lit("1")))
    return out


def attestation_audit(attestations: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """attestations(attestation, mode, claims ARRAY, leaf_count) -> (metric, n, code): the counts, and what does not add up.

    Metrics: attestations, claims (distinct), leaves, live, extract, fixture-only. All come from one scan: every row gives
    its parts of the counts, summed before the shuffle; a claim that many rows map is one key. ``code`` is PARTITION on the row
    of live if extract and fixture-only are not all of it, and DECLARED where ``declared`` (metric, n) differs or lacks the metric.
    """
    part = lambda name, n, claim=None: F.struct(F.lit(name).alias("metric"), F.lit(claim).cast("string").alias("claim") if claim is None else claim.alias("claim"), n.cast("bigint").alias("n"))
    one, zero = F.lit(1), F.lit(0)
    fixed = F.array(
        part("attestations", one), part("live", one), part("leaves", F.coalesce("leaf_count", zero)),
        part("extract", F.when(F.col("mode") == "extract", one).otherwise(zero)), part("fixture-only", F.when(F.col("mode") == "fixture-only", one).otherwise(zero)))
    named = F.transform(F.coalesce("claims", F.array().cast("array<string>")), lambda c: part("claims", one, c.cast("string")))
    parts = attestations.select(F.explode(F.concat(fixed, named)).alias("x")).select("x.*")
    counts = parts.groupBy("metric", "claim").agg(F.sum("n").alias("n")).groupBy("metric").agg(
        F.sum(F.when(F.col("metric") == "claims", F.when(F.col("claim").isNotNull(), 1).otherwise(0)).otherwise(F.col("n"))).alias("n"))
    # six rows from here on; an empty table has its zeros
    names = ("attestations", "claims", "leaves", "live", "extract", "fixture-only")
    every = attestations.sparkSession.createDataFrame([(m,) for m in names], "metric string").join(counts, "metric", "left")
    six = every.select("metric", F.coalesce("n", zero).cast("bigint").alias("n"))
    of = lambda m: F.sum(F.when(F.col("metric") == m, F.col("n")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    broken = (F.col("metric") == "live") & (of("extract") + of("fixture-only") != of("live"))
    if declared is None:
        return six.select("metric", "n", F.when(broken, "PARTITION").alias("code"))
    said = six.join(declared.select("metric", F.col("n").alias("said")), "metric", "left")
    return said.select("metric", "n", F.when(broken, "PARTITION").when(~F.col("said").eqNullSafe(F.col("n")), "DECLARED").alias("code"))
