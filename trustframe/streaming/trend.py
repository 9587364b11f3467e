"""Transient trend as a stream: one state per request, kept by Spark's state store in maps of buckets of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trustframe.operators.drift import EVENT, MAX_TREND_EVENTS, apply_case_actions, case_actions

KEY = "request_key"
STATE_SCHEMA = (
    f"{KEY} string, streak bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, recovered_at timestamp_ntz, "
    f"last_status string, last_observation_id string, events array<{EVENT}>"
)
#: Moments travel as microseconds.
_MOVED = (
    f"{KEY} string, kind string, streak bigint, first_seen bigint, last_seen bigint, recovered_at bigint, last_status string, "
    "last_observation_id string, events array<struct<observed_at:bigint,observation_id:string,status:string>>"
)
#: the newest observation, the trend (NULL: never transient) and its events
_STATE = (
    "at bigint, observation_id string, streak bigint, first_seen bigint, last_seen bigint, recovered_at bigint, last_status string, "
    "last_observation_id string, events array<struct<observed_at:bigint,observation_id:string,status:string>>"
)
_COLUMNS = [KEY, "kind", "streak", "first_seen", "last_seen", "recovered_at", "last_status", "last_observation_id", "events"]
#: Buckets of keys; a checkpoint keeps their number.
_BUCKETS = 1024
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _version(path: str, number: int) -> str:
    return f"{path}/v{number:010d}"


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


class TrendProcessor(StatefulProcessor):
    """State of a key: the newest observation seen, the run of transient ones and its last events.

    A micro-batch's rows of a key are applied in order of time. A row older than the newest one of an earlier batch
    comes out as ``late`` and changes nothing; an observation among the kept events is a replay. Only keys whose state changed come
    out, so a batch writes as many keys as it touches. Rows come by bucket of keys, because a call costs far more than a key;
    a key is one entry of the bucket's map, read once and written once a batch.
    """

    def __init__(self, keep_events: int, ttl_ms: int | None):
        self.keep_events, self.ttl_ms = keep_events, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", f"{KEY} string", _STATE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen: dict[str | None, dict[str, tuple[int, str]]] = {}  # an observation of a key counts once, at its earliest
        for pdf in rows:
            for name, at, observation, status in zip(*(pdf[c].tolist() for c in (KEY, "at", "observation_id", "status")), strict=True):
                own = seen.setdefault(name, {})
                if observation not in own or (at, status) < own[observation]:
                    own[observation] = (at, status)
        out: list[tuple] = []
        for name, own in seen.items():
            self._apply(name, sorted((at, o, s) for o, (at, s) in own.items()), out)
        yield pd.DataFrame(out, columns=_COLUMNS).astype(dict.fromkeys(["streak", "first_seen", "last_seen", "recovered_at"], "Int64"))

    def _apply(self, name: str | None, observations: list[tuple[int, str, str]], out: list[tuple]) -> None:
        kept = self.states.getValue((name,))
        newest = tuple(kept[:2]) if kept else None
        trend = tuple(kept[2:8]) if kept and kept[6] is not None else None
        events = [tuple(e) for e in kept[8]] if trend else []
        known, changed, last = {e[1] for e in events}, False, newest
        for at, observation, status in observations:
            if observation in known:
                continue
            if newest and (at, observation) <= newest:
                if (at, observation) != newest:
                    out.append((name, "late", None, None, at, None, status, observation, None))
                continue
            last = (at, observation)
            running = trend is not None and trend[4] == "transient"
            if status == "transient":
                streak, first = (trend[0] + 1, trend[1]) if running else (1, at)
                events = [*events, (at, observation, status)] if running else [(at, observation, status)]
                trend = (streak, first, at, None, status, observation)
            elif running:
                events = [*events, (at, observation, status)]
                trend = (0, trend[1], at, at, status, observation)
            else:
                continue
            events, changed = events[-self.keep_events :], True
            known = {e[1] for e in events}
        if last != newest:
            self.states.updateValue((name,), (*last, *(trend or [None] * 6), events))
        if changed:
            out.append((name, "state", *trend, [{"observed_at": a, "observation_id": o, "status": s} for a, o, s in events]))

    def close(self) -> None:
        pass


def start_trend_stream(log: DataFrame, state_path: str, checkpoint: str, ttl_ms: int | None = None,
                       keep_events: int = MAX_TREND_EVENTS, **trigger) -> StreamingQuery:
    """Run the trend over a streaming log (request_key, observation_id, observed_at, status).

    State lives in the state store, with the checkpoint (one of an older layout is not read); with ``ttl_ms`` that of a key goes when it was not written for so long.
    Batch ``n`` writes the changed keys and the late rows to ``state_path/batch=n``; a repeated batch writes the
    same folder again. Both folders must be shared ones.
    """
    spark = log.sparkSession
    rows = log.select(KEY, "observation_id", F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, observed_at)").alias("at"), "status")
    bucket = F.pmod(F.xxhash64(KEY), F.lit(_BUCKETS)).alias("bucket")
    changes = rows.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        TrendProcessor(keep_events, ttl_ms), _MOVED, "Update", "ProcessingTime" if ttl_ms else "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    spark.createDataFrame([], _MOVED).write.mode("overwrite").parquet(f"{state_path}/batch=-1")  # a stream without rows has a state, too
    before = spark.conf.get(_ROCKS[0])
    spark.conf.set(*_ROCKS)  # only this store holds several states a key; a query keeps the setting that it started with
    try:
        writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_ROCKS[0], before)


def _changes(spark: SparkSession, state_path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{_MOVED}, batch bigint").parquet(state_path).filter(F.col("kind") == kind)


def _moment(micros: str) -> str:
    return f"timestampadd(MICROSECOND, {micros}, {_EPOCH})"


def finished_state(spark: SparkSession, query: StreamingQuery, state_path: str) -> DataFrame:
    """State after the last finished micro-batch of a stopped query: the newest change of every key."""
    names = [c for c in spark.createDataFrame([], _MOVED).columns if c not in (KEY, "kind")]
    newest = _changes(spark, state_path, "state").groupBy(KEY).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(KEY, "s.*")
    times = {c: F.expr(_moment(c)) for c in ("first_seen", "last_seen", "recovered_at")}
    moved = f"transform(events, e -> named_struct('observed_at', {_moment('e.observed_at')}, 'observation_id', e.observation_id, 'status', e.status))"
    return newest.withColumns(times | {"events": F.expr(moved)}).select(*empty_state(spark).columns)


def late_observations(spark: SparkSession, state_path: str) -> DataFrame:
    """(request_key, observation_id, observed_at, status) of the rows that came after newer ones of their key; no state holds them."""
    return _changes(spark, state_path, "late").select(
        KEY, F.col("last_observation_id").alias("observation_id"), F.expr(_moment("last_seen")).alias("observed_at"), F.col("last_status").alias("status"))


def start_case_stream(findings: DataFrame, case_path: str, checkpoint: str, key: str, **trigger) -> StreamingQuery:
    """Apply finding batches (key, has_finding, fingerprint) to a versioned case table."""
    schema = f"{key} string, state string, fingerprint string"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cases = spark.createDataFrame([], schema) if batch_id == 0 else spark.read.schema(schema).parquet(_version(case_path, batch_id))
        seen = batch.groupBy(key).agg(F.bool_or("has_finding").alias("has_finding"), F.max("fingerprint").alias("fingerprint"))
        touched = cases.join(seen.select(key), key, "left_semi")
        actions = case_actions(seen, touched, key)
        rest = cases.join(seen.select(key), key, "left_anti")
        after = apply_case_actions(touched, actions, key).unionByName(rest)
        after.write.mode("overwrite").parquet(_version(case_path, batch_id + 1))

    writer = findings.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
