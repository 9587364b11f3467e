"""Drift: candidate fallback, attempt roll-up, transient trend, case actions, review deadlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.operators.ranking import last_n
from trustframe.policies import MAX_TREND_EVENTS

EVENT = "struct<observed_at:timestamp_ntz,observation_id:string,status:string>"


def fallback_choice(candidates: DataFrame, keys: Sequence[str], index: str, status: str,
                    policy: str = "first-match") -> DataFrame:
    """Which candidate decides, per key. Partial aggregates only; ``index`` starts at 0.

    first-match: stop at the first match or change, else the last candidate.
    available-parity: the first change, else the first match, else the first candidate.
    ``chain_length`` is the number of candidates looked at.
    """
    idx = F.col(index)
    agg = candidates.groupBy(*keys).agg(
        F.min(F.when(F.col(status) == "changed", idx)).alias("c"),
        F.min(F.when(F.col(status) == "match", idx)).alias("m"),
        F.min(idx).alias("first"), F.max(idx).alias("last"),
        F.min_by(status, index).alias("first_status"), F.max_by(status, index).alias("last_status"),
    )
    if policy == "first-match":
        stop = F.least("c", "m")
        chosen = F.coalesce(stop, F.col("last"))
        final = (
            F.when(stop.isNull(), F.col("last_status")).when(F.col("c") == stop, F.lit("changed")).otherwise(F.lit("match"))
        )
        looked = chosen - F.col("first") + 1
        selected = F.when(F.col("m") == stop, F.col("m"))
    elif policy == "available-parity":
        chosen = F.coalesce("c", "m", "first")
        final = (
            F.when(F.col("c").isNotNull(), F.lit("changed")).when(F.col("m").isNotNull(), F.lit("match"))
            .otherwise(F.col("first_status"))
        )
        looked = F.coalesce("c", "last") - F.col("first") + 1
        selected = F.when(F.col("c").isNull() | (F.col("m") < F.col("c")), F.col("m"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return agg.select(
        *keys, chosen.alias("decided_by"), final.alias("final_status"), looked.alias("chain_length"),
        selected.alias("selected"),
    )


def evaluated_chain(candidates: DataFrame, choice: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Candidates that were looked at: the prefix of length ``chain_length``."""
    c = choice.select(*keys, "chain_length")
    return candidates.join(c, list(keys)).filter(F.col(index) < F.col("chain_length")).drop("chain_length")


def attempt_rollup(attempts: DataFrame, keys: Sequence[str], number: str, status: str,
                   max_attempts: int = 4) -> DataFrame:
    """Per request: attempts, retried, final status (last attempt), and whether numbering is 1..n."""
    agg = attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.max_by(status, number).alias("final_status"),
        F.min(number).alias("__lo"), F.max(number).alias("__hi"), F.countDistinct(number).alias("__d"),
    )
    numbered = (F.col("__lo") == 1) & (F.col("__hi") == F.col("attempts")) & (F.col("__d") == F.col("attempts"))
    return agg.select(
        *keys, "attempts", (F.col("attempts") > 1).alias("retried"), "final_status",
        numbered.alias("numbering_ok"), (F.col("attempts") > max_attempts).alias("over_budget"),
    )


def first_sightings(log: DataFrame, key: str = "request_key", observation: str = "observation_id",
                    moment: str = "observed_at") -> DataFrame:
    """One row per (key, observation): replays of an observation are ignored, the earliest counts."""
    rest = [c for c in log.columns if c not in (key, observation)]
    ordered = F.struct(*[moment, *[c for c in rest if c != moment]])
    best = log.groupBy(key, observation).agg(F.min(ordered).alias("__s"))
    return best.select(key, observation, "__s.*").select(*log.columns)


def transient_trend(log: DataFrame, key: str = "request_key", observation: str = "observation_id",
                    moment: str = "observed_at", status: str = "status",
                    keep_events: int = MAX_TREND_EVENTS) -> DataFrame:
    """Trend state of every key that was ever transient, from its whole observation log."""
    return trend_summary(log, key, observation, moment, status, keep_events).drop("from_start")


def trend_summary(log: DataFrame, key: str = "request_key", observation: str = "observation_id",
                  moment: str = "observed_at", status: str = "status",
                  keep_events: int = MAX_TREND_EVENTS) -> DataFrame:
    """Trend state of every key that was ever transient, from its whole observation log.

    The state depends only on the last run of transient observations and on the first other
    observation after it (``from_start``: the run begins with the log). Both are found with partial aggregates keyed by request and one bounded
    top-n, so a key with a huge log is spread over tasks.
    """
    rows = first_sightings(log.select(key, observation, moment, status), key, observation, moment)
    at = F.struct(F.col(moment).alias("t"), F.col(observation).alias("o"))
    rows = rows.withColumn("__at", at).withColumn("__tr", F.col(status) == "transient")
    last_run = rows.filter("__tr").groupBy(key).agg(F.max("__at").alias("__end"))
    marked = rows.join(last_run, key)
    edges = marked.groupBy(key).agg(
        F.max(F.when(~F.col("__tr") & (F.col("__at") < F.col("__end")), F.col("__at"))).alias("__before"),
        F.min(
            F.when(
                ~F.col("__tr") & (F.col("__at") > F.col("__end")),
                F.struct("__at", F.col(status).alias("s")),
            )
        ).alias("__after"),
        F.max("__end").alias("__end"),
    )
    run = rows.join(edges, key).filter(
        (F.col("__tr") & (F.col("__before").isNull() | (F.col("__at") > F.col("__before"))))
        | (F.col("__at") == F.col("__after.__at"))
    )
    counts = run.groupBy(key).agg(
        F.count_if("__tr").alias("__streak"), F.min(F.when(F.col("__tr"), F.col(moment))).alias("first_seen"),
        F.max("__end").alias("__end"), F.max("__after").alias("__after"),
        F.bool_and(F.col("__before").isNull()).alias("from_start"),
    )
    newest = last_n(run.select(key, moment, observation, status), [key],
                    [F.col(moment).desc(), F.col(observation).desc()], keep_events)
    events = newest.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col(moment).alias("observed_at"), F.col(observation).alias("observation_id"),
                         F.col(status).alias("status"))
            )
        ).alias("events")
    )
    over = F.col("__after").isNotNull()
    return counts.join(events, key).select(
        key,
        F.when(over, F.lit(0)).otherwise(F.col("__streak")).cast("bigint").alias("streak"),
        "first_seen",
        F.coalesce(F.col("__after.__at.t"), F.col("__end.t")).alias("last_seen"),
        F.col("__after.__at.t").alias("recovered_at"),
        F.when(over, F.col("__after.s")).otherwise(F.lit("transient")).alias("last_status"),
        F.coalesce(F.col("__after.__at.o"), F.col("__end.o")).alias("last_observation_id"),
        "events", "from_start",
    )


def advance_trend(state: DataFrame, report: DataFrame, key: str = "request_key",
                  keep_events: int = MAX_TREND_EVENTS, retire: bool = True) -> DataFrame:
    """Apply one report (one row per key: observation_id, observed_at, status) to the state table.

    With ``retire`` keys absent from the report are dropped. An observation already among the kept
    events changes nothing; a key that is not transient and has no state stays without state.
    """
    r = report.select(
        F.col(key).alias("__k"), F.col("observation_id").alias("__o"), F.col("observed_at").alias("__t"),
        F.col("status").alias("__s"),
    )
    how = "right" if retire else "full_outer"
    j = state.join(r, F.col(key) == F.col("__k"), how)
    known = F.col(key).isNotNull()
    replay = F.exists("events", lambda e: e["observation_id"] == F.col("__o"))
    untouched = F.col("__k").isNull() | F.coalesce(replay, F.lit(False))
    was_transient = F.coalesce(F.col("last_status") == "transient", F.lit(False))
    now_transient = F.col("__s") == "transient"
    event = F.array(F.struct(F.col("__t").alias("observed_at"), F.col("__o").alias("observation_id"),
                             F.col("__s").alias("status")))
    grown = F.when(was_transient, F.concat("events", event)).otherwise(event)
    kept = F.slice(grown, F.greatest(F.size(grown) - keep_events + 1, F.lit(1)), keep_events)
    keep = untouched | (~now_transient & ~was_transient)
    recovering = ~now_transient & was_transient
    rows = j.filter(F.when(untouched, known).otherwise(now_transient | known))
    return rows.select(
        F.coalesce(F.col(key), F.col("__k")).alias(key),
        F.when(keep, F.col("streak")).when(recovering, F.lit(0))
        .when(was_transient, F.col("streak") + 1).otherwise(F.lit(1)).cast("bigint").alias("streak"),
        F.when(keep | was_transient, F.col("first_seen")).otherwise(F.col("__t")).alias("first_seen"),
        F.when(keep, F.col("last_seen")).otherwise(F.col("__t")).alias("last_seen"),
        F.when(keep, F.col("recovered_at")).when(recovering, F.col("__t")).alias("recovered_at"),
        F.when(keep, F.col("last_status")).otherwise(F.col("__s")).alias("last_status"),
        F.when(keep, F.col("last_observation_id")).otherwise(F.col("__o")).alias("last_observation_id"),
        F.when(keep, F.col("events")).otherwise(kept).alias("events"),
    )


def merge_trend(state: DataFrame, log: DataFrame, key: str = "request_key",
                keep_events: int = MAX_TREND_EVENTS) -> DataFrame:
    """State after a further stretch of log (key, observation_id, observed_at, status).

    The stretch is summarised with partial aggregates first, then merged key by key, so a hot key
    costs one state row. Observations among the kept events of a key are replays and are skipped.
    """
    kept = state.select(F.col(key).alias("__k"), F.explode("events").alias("__e")).select("__k", F.col("__e.observation_id").alias("__o"))
    fresh = log.join(kept, (F.col(key) == F.col("__k")) & (F.col("observation_id") == F.col("__o")), "left_anti")
    run = trend_summary(fresh, key, keep_events=keep_events)
    run = run.select(F.col(key).alias("__k"), *[F.col(c).alias(f"n_{c}") for c in run.columns if c != key])
    other = fresh.filter("status <> 'transient'").groupBy(F.col(key).alias("__ok")).agg(
        F.min(F.struct("observed_at", "observation_id", "status")).alias("__first")
    )
    j = state.join(run, F.col(key) == F.col("__k"), "full_outer").join(other, F.coalesce(key, "__k") == F.col("__ok"), "left")
    active = F.coalesce(F.col("last_status") == "transient", F.lit(False))
    has_run = F.col("__k").isNotNull()
    extends = has_run & active & F.col("n_from_start")
    ends = ~has_run & active & F.col("__first").isNotNull()
    grown = (
        F.when(extends, F.concat("events", "n_events")).when(has_run, F.col("n_events"))
        .when(ends, F.concat("events", F.array("__first"))).otherwise(F.col("events"))
    )

    def pick(name: str, at_end: Column) -> Column:
        return F.when(has_run, F.col(f"n_{name}")).when(ends, at_end).otherwise(F.col(name)).alias(name)

    streak = F.when(extends & (F.col("n_streak") > 0), F.col("streak") + F.col("n_streak")).when(has_run, F.col("n_streak")).when(
        ends, F.lit(0)
    ).otherwise(F.col("streak"))
    return j.select(
        F.coalesce(key, "__k").alias(key), streak.cast("bigint").alias("streak"),
        F.when(has_run & ~extends, F.col("n_first_seen")).otherwise(F.col("first_seen")).alias("first_seen"),
        pick("last_seen", F.col("__first.observed_at")), pick("recovered_at", F.col("__first.observed_at")),
        pick("last_status", F.col("__first.status")), pick("last_observation_id", F.col("__first.observation_id")),
        F.slice(grown, F.greatest(F.size(grown) - keep_events + 1, F.lit(1)), keep_events).alias("events"),
    )


def case_actions(findings: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """create / reopen / update / noop / close per case.

    ``findings``: (key, has_finding, fingerprint); ``cases``: (key, state open|closed, fingerprint).
    """
    f = findings.select(F.col(key), "has_finding", F.col("fingerprint").alias("new_fingerprint"))
    c = cases.select(F.col(key), F.lower("state").alias("state"), F.col("fingerprint").alias("old_fingerprint"))
    j = f.join(c, key, "full_outer")
    found = F.coalesce("has_finding", F.lit(False))
    action = (
        F.when(found & F.col("state").isNull(), F.lit("create"))
        .when(found & (F.col("state") == "closed"), F.lit("reopen"))
        .when(found & F.col("new_fingerprint").eqNullSafe(F.col("old_fingerprint")), F.lit("noop"))
        .when(found, F.lit("update"))
        .when(F.col("state") == "open", F.lit("close"))
        .otherwise(F.lit("noop"))
    )
    return j.select(key, action.alias("action"), "state", "old_fingerprint", "new_fingerprint")


def apply_case_actions(cases: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Case table after the actions (what a sink upserts)."""
    a = actions.select(F.col(key).alias("__k"), "action", "new_fingerprint")
    j = cases.select(key, "state", "fingerprint").join(a, F.col(key) == F.col("__k"), "full_outer")
    writes = F.col("action").isin("create", "reopen", "update")
    return j.select(
        F.coalesce(F.col(key), F.col("__k")).alias(key),
        F.when(writes, F.lit("open")).when(F.col("action") == "close", F.lit("closed")).otherwise(F.col("state")).alias("state"),
        F.when(writes, F.col("new_fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"),
    ).filter(F.col("state").isNotNull())


def with_review_deadline(status: Column, verified: Column, review_days: Column, fixture_only: Column,
                         as_of: Column) -> Column:
    """A match that rests on a manual review turns unsupported the day after the review was due."""
    overdue = F.datediff(as_of, F.date_add(verified, review_days)) > 0
    return F.when((status == "match") & fixture_only & overdue, F.lit("unsupported")).otherwise(status)


def report_contract_problems(results: DataFrame) -> DataFrame:
    """Rows of a link report that break its contract, as (url, code). Duplicate urls come from a count."""
    https = F.startswith(F.col("url"), F.lit("https://"))
    bad_status = ~F.col("status").isin("match", "changed", "blocked", "transient", "unsupported")
    owners = F.col("owner_ids")
    roles_bad = (F.size("roles") < 1) | (F.size(F.array_except("roles", F.array(F.lit("source"), F.lit("contact")))) > 0)
    owners_bad = (F.size(owners) < 1) | (F.size(F.array_distinct(owners)) != F.size(owners)) | F.exists(owners, lambda o: o == "")
    text_bad = F.lit(False)
    for name in ("actual", "expected", "fix"):
        text_bad = text_bad | ~F.coalesce(F.length(name).between(1, 2000), F.lit(False))
    checks = {
        "URL": ~F.coalesce(https, F.lit(False)), "STATUS": F.coalesce(bad_status, F.lit(True)),
        "OWNERS": F.coalesce(owners_bad, F.lit(True)), "ROLES": F.coalesce(roles_bad, F.lit(True)),
        "HTTP_STATUS": F.coalesce(~F.col("http_status").between(100, 599), F.lit(False)), "TEXT": text_bad,
    }
    codes = F.array_compact(F.array(*[F.when(b, F.lit(c)) for c, b in checks.items()]))
    per_row = results.select("url", F.explode(codes).alias("code"))
    repeated = results.groupBy("url").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(
        "url", F.lit("DUPLICATE").alias("code")
    )
    return per_row.unionByName(repeated)
