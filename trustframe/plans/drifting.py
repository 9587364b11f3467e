"""Responses, fallback, attempts, trend, cases: queries over events and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trustframe.functions import classify
from trustframe.functions.fingerprints import short_sha
from trustframe.functions.urls import host
from trustframe.operators import drift as D
from trustframe.operators import ranking, rules
from trustframe.operators.reconcile import prune_retired
from trustframe.plans.registry import plan
from trustframe.session import checkpoint_root, cut_lineage, load_table
from trustframe.streaming import trend as S

STATUS_SQL = "CASE event_type WHEN 'error' THEN 'transient' WHEN 'view' THEN 'changed' WHEN 'signup' THEN 'blocked' ELSE 'ready' END"


def status_of(event_type):
    return (
        F.when(event_type == "error", F.lit("transient")).when(event_type == "view", F.lit("changed"))
        .when(event_type == "signup", F.lit("blocked")).otherwise(F.lit("ready"))
    )


def observation_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("request_key"), F.col("event_id").cast("string").alias("observation_id"),
        F.col("ts").cast("timestamp_ntz").alias("observed_at"), status_of(F.col("event_type")).alias("status"),
    )


RESPONSE_SQL = """
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events),
r AS (SELECT event_id, k=50 AS err, user_id<>7 AS host_ok, CASE event_type WHEN 'signup' THEN 404 WHEN 'error' THEN 503 WHEN 'purchase' THEN CASE WHEN k < 50 THEN 401 ELSE 200 END ELSE 200 END AS code,
  k < 20 AS blank, k BETWEEN 20 AND 39 AS login, k > 90 AS big FROM e)
SELECT event_id, CASE WHEN err THEN 'transient' WHEN NOT host_ok THEN 'unsupported' WHEN code=503 THEN 'transient' WHEN code=401 THEN 'blocked' WHEN code<>200 OR blank THEN 'changed' WHEN login THEN 'blocked' WHEN big THEN 'unsupported' ELSE 'ready' END AS request,
 CASE WHEN err THEN 'transient' WHEN NOT host_ok THEN 'unsupported' WHEN code=401 OR login THEN 'blocked' WHEN code=503 THEN 'transient' WHEN big THEN 'unsupported' WHEN code<>200 OR blank THEN 'changed' ELSE 'match' END AS result,
 CASE WHEN err THEN 'transient' WHEN code=401 THEN 'blocked' WHEN code=503 THEN 'transient' WHEN code<>200 THEN 'changed' WHEN NOT host_ok THEN 'unsupported' WHEN blank THEN 'changed' WHEN login THEN 'blocked' ELSE 'match' END AS link FROM r
"""


@plan("response_class", RESPONSE_SQL)
def response_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events")
    rows = e.select("event_id", "event_type", "user_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    k, t = F.col("k"), F.col("event_type")
    args = dict(
        error=F.when(k == 50, F.lit("timeout")), host_ok=F.col("user_id") != 7,
        status=F.when(t == "signup", F.lit(404)).when(t == "error", F.lit(503)).when((t == "purchase") & (k < 50), F.lit(401)).otherwise(F.lit(200)),
        body=F.when(k < 20, F.lit(" \n")).when(k < 40, F.lit('<form><input type="password">Log in</form>')).otherwise(F.lit("ok")),
        media=F.lit("text/html; charset=utf-8"), too_large=k > 90,
    )
    return rows.select("event_id", *[classify.response_class(p, **args).alias(p) for p in ("request", "result", "link")])


@plan("latency_and_media", """
WITH e AS (SELECT event_id, event_type, value * 50 AS ms, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN ms < 250 THEN 'lt250ms' WHEN ms < 1000 THEN '250ms-999ms' WHEN ms < 5000 THEN '1s-4.999s' WHEN ms < 15000 THEN '5s-14.999s' ELSE '15s-plus' END AS bucket,
 CASE event_type WHEN 'view' THEN k < 50 WHEN 'purchase' THEN k >= 50 ELSE false END AS media_ok FROM e
""")
def latency_and_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events")
    t = F.col("event_type")
    mode = F.when(t == "view", F.lit("html-table")).when(t == "click", F.lit("pdf-table")).when(t == "signup", F.lit("cra-t4127-csv")).when(t == "error", F.lit("iec-quota-xml")).otherwise(F.lit("json-pointer"))
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    media = F.when(k < 50, F.lit("Text/HTML; charset=utf-8")).otherwise(F.lit("application/problem+json"))
    return e.select("event_id", classify.latency_bucket(F.col("value") * 50).alias("bucket"), classify.media_allowed(mode, media).alias("media_ok"))


CAND_SQL = """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
  CASE event_type WHEN 'view' THEN 'match' WHEN 'signup' THEN 'changed' ELSE 'transient' END AS status FROM events),
a AS (SELECT user_id, day, min(idx) FILTER (WHERE status='changed') AS c, min(idx) FILTER (WHERE status='match') AS m, max(idx) AS last, arg_min(status, idx) AS fs, arg_max(status, idx) AS ls FROM c GROUP BY 1,2)
"""


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.col("ts").cast("date").alias("day"))
    numbered = ranking.occurrence_number(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), "n")
    t = F.col("event_type")
    status = F.when(t == "view", F.lit("match")).when(t == "signup", F.lit("changed")).otherwise(F.lit("transient"))
    return numbered.select("user_id", F.col("day").cast("string").alias("day"), (F.col("n") - 1).alias("idx"), status.alias("status"))


@plan("fallback_choice", CAND_SQL + """
SELECT 'first-match' AS policy, user_id, strftime(day,'%Y-%m-%d') AS day, coalesce(least(c, m), last) AS decided_by, CASE WHEN least(c,m) IS NULL THEN ls WHEN c=least(c,m) THEN 'changed' ELSE 'match' END AS final_status,
 coalesce(least(c, m), last) + 1 AS chain_length, CASE WHEN m = least(c,m) THEN m END AS selected FROM a
UNION ALL SELECT 'available-parity', user_id, strftime(day,'%Y-%m-%d'), coalesce(c, m, 0), CASE WHEN c IS NOT NULL THEN 'changed' WHEN m IS NOT NULL THEN 'match' ELSE fs END, coalesce(c, last) + 1, CASE WHEN c IS NULL OR m < c THEN m END FROM a
""")
def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidate_rows(spark, sf_dir)
    out = [D.fallback_choice(rows, ["user_id", "day"], "idx", "status", p).select(F.lit(p).alias("policy"), "*") for p in ("first-match", "available-parity")]
    return out[0].unionByName(out[1])


@plan("evaluated_chain", CAND_SQL + """
SELECT c.user_id, strftime(c.day,'%Y-%m-%d') AS day, idx, status FROM c JOIN a ON c.user_id=a.user_id AND c.day=a.day WHERE idx <= coalesce(least(a.c, a.m), last)
""")
def evaluated_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidate_rows(spark, sf_dir)
    return D.evaluated_chain(rows, D.fallback_choice(rows, ["user_id", "day"], "idx", "status"), ["user_id", "day"], "idx")


@plan("attempt_rollup", CAND_SQL + """
SELECT user_id, strftime(day,'%Y-%m-%d') AS day, count(*) AS attempts, count(*) > 1 AS retried, arg_max(status, idx) AS final_status, count(*) = max(idx) + 1 AS numbering_ok, count(*) > 4 AS over_budget FROM c GROUP BY 1,2
""")
def attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidate_rows(spark, sf_dir).withColumn("number", F.col("idx") + 1)
    return D.attempt_rollup(rows, ["user_id", "day"], "number", "status")


def trend_sql(name: str, where: str = "true") -> str:
    return f"""
{name}_e AS (SELECT user_id, event_id, ts, {STATUS_SQL} AS st FROM events WHERE {where}),
{name}_t AS (SELECT user_id, max(ts) AS t_end FROM {name}_e WHERE st='transient' GROUP BY 1),
{name}_g AS (SELECT e.user_id, t_end, max(ts) FILTER (WHERE st<>'transient' AND ts < t_end) AS n, min(ts) FILTER (WHERE st<>'transient' AND ts > t_end) AS r FROM {name}_e e JOIN {name}_t USING (user_id) GROUP BY 1,2),
{name}_run AS (SELECT e.user_id, e.ts, e.event_id, e.st, t_end, r FROM {name}_e e JOIN {name}_g g USING (user_id) WHERE (st='transient' AND (n IS NULL OR ts > n)) OR ts = r),
{name} AS (SELECT CAST(user_id AS VARCHAR) AS request_key, CASE WHEN max(r) IS NULL THEN count(*) ELSE 0 END AS streak, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_seen,
  strftime(max(r),'%Y-%m-%d %H:%M:%S') AS recovered_at, arg_max(st, ts) AS last_status, CAST(arg_max(event_id, ts) AS VARCHAR) AS last_observation_id,
  array_to_string(list_reverse(list_slice(list(event_id ORDER BY ts DESC), 1, 8)), ',') AS events FROM {name}_run GROUP BY user_id)"""


def readable(state: DataFrame) -> DataFrame:
    fmt = "yyyy-MM-dd HH:mm:ss"
    return state.select(
        "request_key", "streak", *[F.date_format(c, fmt).alias(c) for c in ("first_seen", "last_seen", "recovered_at")],
        "last_status", "last_observation_id", F.array_join(F.transform("events", lambda e: e["observation_id"]), ",").alias("events"),
    )


@plan("transient_trend", "WITH" + trend_sql("s") + " SELECT * FROM s")
def transient_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(D.transient_trend(observation_log(load_table(spark, sf_dir, "events"))))


@plan("transient_trend_merged", "WITH" + trend_sql("s") + " SELECT * FROM s")
def transient_trend_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state, built from two successive stretches of the log."""
    log = observation_log(load_table(spark, sf_dir, "events"))
    first = cut_lineage(D.transient_trend(log.filter("observed_at < '2024-01-16'")))  # the stored state
    return readable(D.merge_trend(first, log.filter("observed_at >= '2024-01-16'")))


def stream_in_stretches(spark: SparkSession, stretches: list[DataFrame]) -> tuple[StreamingQuery, str]:
    """Run the trend over stretches of a log that arrive one after another, a micro-batch each; the folder of its state.

    A stretch is written by as many tasks as read it; the query then takes all its files as one batch, from where it stopped.
    """
    work = f"{checkpoint_root(spark)}/trend-{uuid.uuid4().hex}"
    for stretch in stretches:
        stretch.write.mode("append").parquet(f"{work}/log")
        source = spark.readStream.schema(stretch.schema).parquet(f"{work}/log")
        query = S.start_trend_stream(source, f"{work}/state", f"{work}/checkpoint")
        query.awaitTermination()
    return query, f"{work}/state"


CUTS = ("2024-01-01", "2024-01-11", "2024-01-21", "9999-01-01")


def log_stretches(log: DataFrame) -> list[DataFrame]:
    moment = F.col("observed_at")
    first = [log.filter(moment < CUTS[1])]
    return first + [log.filter((moment >= a) & (moment < b)) for a, b in zip(CUTS[1:], CUTS[2:], strict=False)]


@plan("transient_trend_stream", "WITH" + trend_sql("s") + " SELECT * FROM s")
def transient_trend_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from a stream of three micro-batches over the events table."""
    query, state = stream_in_stretches(spark, log_stretches(observation_log(load_table(spark, sf_dir, "events"))))
    return readable(S.finished_state(spark, query, state))


@plan("late_observations", """
SELECT CAST(user_id AS VARCHAR) AS request_key, 'late-' || event_id AS observation_id FROM events e
WHERE ts < TIMESTAMP '2024-01-11' AND event_id % 50 = 0 AND EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.ts >= TIMESTAMP '2024-01-11' AND n.ts < TIMESTAMP '2024-01-21')
""")
def late_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the first stretch that arrive with the third, under other names: all that are older than what is known."""
    log = observation_log(load_table(spark, sf_dir, "events"))
    first, second, third = log_stretches(log)
    late = first.filter(F.col("observation_id").cast("bigint") % 50 == 0).withColumn("observation_id", F.concat(F.lit("late-"), "observation_id"))
    seen = second.select("request_key").distinct()  # a key's rows of one batch are in order whatever their place in it
    _, state = stream_in_stretches(spark, [first, second, late.join(seen, "request_key", "left_semi"), third])
    return S.late_observations(spark, state).select("request_key", "observation_id")


@plan("advance_trend", """
WITH a AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS t1, arg_max(event_type, event_id) AS t2 FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS request_key, CASE WHEN t2='error' THEN CASE WHEN t1='error' THEN 2 ELSE 1 END ELSE 0 END AS streak FROM a WHERE t2='error' OR t1='error'
""")
def advance_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two successive reports (the latest observation of each key before and after a cut)."""
    log = observation_log(load_table(spark, sf_dir, "events"))

    def report(rows: DataFrame, name: str) -> DataFrame:
        last = rows.groupBy("request_key").agg(F.max_by(F.struct("observed_at", "status"), F.col("observation_id").cast("bigint")).alias("x"))
        return last.select("request_key", F.lit(name).alias("observation_id"), "x.observed_at", "x.status")

    state = D.advance_trend(S.empty_state(spark), report(log.filter("observed_at < '2024-01-16'"), "run-1"))
    state = prune_retired(state, log, "request_key")
    return D.advance_trend(state, report(log, "run-2")).select("request_key", "streak")


@plan("state_contract", "WITH" + trend_sql("s") + " SELECT request_key, 'STREAK_RANGE' AS code FROM s WHERE CAST(request_key AS BIGINT) >= 50 UNION ALL SELECT request_key, 'SEEN_ORDER' FROM s WHERE CAST(request_key AS BIGINT) BETWEEN 20 AND 29")
def state_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = D.transient_trend(observation_log(load_table(spark, sf_dir, "events")))
    n = F.col("request_key").cast("bigint")
    changed = state.withColumn("streak", F.when(n >= 50, F.lit(-1)).otherwise(F.col("streak"))).withColumn(
        "first_seen", F.when(n.between(20, 29), F.lit("2030-01-01").cast("timestamp_ntz")).otherwise(F.col("first_seen"))
    )
    codes = rules.state_contract_breaks(*[F.col(c) for c in ("streak", "first_seen", "last_seen", "recovered_at", "last_status", "last_observation_id", "events")])
    return changed.select("request_key", F.explode(codes).alias("code"))


CASE_SQL = "WITH" + trend_sql("p", "ts < TIMESTAMP '2024-01-16'") + "," + trend_sql("s") + """,
f AS (SELECT request_key, streak > 0 AS found, substr(sha256(CAST(streak AS VARCHAR) || chr(0) || last_observation_id),1,16) AS fp FROM s),
c AS (SELECT request_key, CASE WHEN streak > 0 THEN 'open' ELSE 'closed' END AS state, substr(sha256(CAST(streak AS VARCHAR) || chr(0) || last_observation_id),1,16) AS fp FROM p WHERE request_key NOT LIKE '%3')
SELECT request_key, CASE WHEN coalesce(found,false) AND state IS NULL THEN 'create' WHEN coalesce(found,false) AND state='closed' THEN 'reopen' WHEN coalesce(found,false) AND f.fp=c.fp THEN 'noop' WHEN coalesce(found,false) THEN 'update' WHEN state='open' THEN 'close' ELSE 'noop' END AS action
FROM f FULL JOIN c USING (request_key)
"""


@plan("case_actions", CASE_SQL)
def case_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = observation_log(load_table(spark, sf_dir, "events"))
    print_of = short_sha([F.col("streak").cast("string"), F.col("last_observation_id")], 16)
    now = D.transient_trend(log).select("request_key", (F.col("streak") > 0).alias("has_finding"), print_of.alias("fingerprint"))
    before = D.transient_trend(log.filter("observed_at < '2024-01-16'")).filter(~F.col("request_key").like("%3")).select(
        "request_key", F.when(F.col("streak") > 0, F.lit("open")).otherwise(F.lit("closed")).alias("state"), print_of.alias("fingerprint")
    )
    return D.case_actions(now, before, "request_key").select("request_key", "action")


@plan("review_deadline", """
SELECT o_orderkey, CASE WHEN o_orderstatus='O' AND o_orderpriority='5-LOW' AND date_diff('day', CAST(o_orderdate AS DATE) + 365, DATE '2000-01-01') > 0 THEN 'unsupported' WHEN o_orderstatus='O' THEN 'match' ELSE 'changed' END AS status FROM orders
""")
def review_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", F.lit("match")).otherwise(F.lit("changed"))
    day = F.col("o_orderdate").cast("date")
    out = D.with_review_deadline(status, day, F.lit(365), F.col("o_orderpriority") == "5-LOW", F.lit("2000-01-01").cast("date"))
    return o.select("o_orderkey", out.alias("status"))


@plan("report_contract", r"""
WITH r AS (SELECT CASE WHEN url LIKE 'http:%' THEN url ELSE 'https://' || lower(regexp_extract(url,'^[a-z]+://([^/?#]*)',1)) || '/' END AS url, regexp_extract(url,'^[a-z]+://[^/]*/([a-z]+)/',1) AS lang, url LIKE '%.html' AS h FROM pages)
SELECT url, 'URL' AS code FROM r WHERE url LIKE 'http:%' UNION ALL SELECT url, 'STATUS' FROM r WHERE lang='es' UNION ALL SELECT url, 'OWNERS' FROM r WHERE lang='fr' UNION ALL SELECT url, 'ROLES' FROM r WHERE lang='de' UNION ALL SELECT url, 'HTTP_STATUS' FROM r WHERE h
UNION ALL SELECT url, 'DUPLICATE' FROM r GROUP BY 1 HAVING count(*) > 1
""")
def report_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_table(spark, sf_dir, "pages").select("url")
    lang = F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1)
    u = F.col("url")
    rows = p.select(
        F.when(u.like("http:%"), u).otherwise(F.concat(F.lit("https://"), host(u), F.lit("/"))).alias("url"),
        F.when(lang == "fr", F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("owner_ids"),
        F.when(lang == "de", F.array(F.lit("other"))).otherwise(F.array(F.lit("source"))).alias("roles"),
        F.when(lang == "es", F.lit("odd")).otherwise(F.lit("match")).alias("status"), F.when(u.like("%.html"), F.lit(99)).otherwise(F.lit(200)).alias("http_status"),
        F.lit("x").alias("actual"), F.lit("x").alias("expected"), F.lit("x").alias("fix"),
    )
    return D.report_contract_problems(rows)
