"""Batch twins of the streaming jobs, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import table
from ..streaming import jobs as J
from .registry import query

EVENTS = """WITH e AS (SELECT user_id AS job_id, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value,
  CASE event_type WHEN 'signup' THEN 'upload_complete' WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_complete' WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'pipeline_complete' ELSE 'step_warning' END
    ELSE CASE WHEN event_id % 40 = 0 THEN 'pipeline_error' ELSE 'quota_limit' END END AS event, event_type FROM events),
v AS (SELECT *, CASE WHEN event IN ('step_start', 'step_complete', 'step_warning') THEN k % 7 END AS step,
  CASE WHEN event = 'quota_limit' THEN CASE k % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'search' ELSE 'pages' END END AS service FROM e)
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events of jobs: a user's events, renamed."""
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    t, i = F.col("event_type"), F.col("event_id")
    event = F.when(t == "signup", "upload_complete").when(t == "view", "step_start").when(t == "click", "step_complete").when(t == "purchase", F.when(i % 50 == 0, "pipeline_complete").otherwise("step_warning")).otherwise(F.when(i % 40 == 0, "pipeline_error").otherwise("quota_limit"))
    df = events.select(F.col("user_id").alias("job_id"), "ts", i.alias("seq"), event.alias("event"), k.alias("k"))
    step = F.when(F.col("event").isin("step_start", "step_complete", "step_warning"), F.col("k") % len(J.STEPS))
    service = F.when(F.col("event") == "quota_limit", F.get(F.array(F.lit("model"), F.lit("search"), F.lit("pages")), F.col("k") % 3))
    return df.withColumn("step", step).withColumn("service", service).withColumn("message", F.lit(None).cast("string")).drop("k")


# The fold of a job's events, one event after the other.
FOLD = (
    EVENTS.replace("WITH e", "WITH RECURSIVE e", 1)
    + """, x AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS n, event, step FROM v),
f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, ['pending', 'pending', 'pending', 'pending', 'pending', 'pending', 'pending'] AS s, false AS ended FROM x
UNION ALL SELECT f.job_id, x.n, CASE WHEN ended THEN s WHEN event = 'upload_complete' THEN list_concat(['complete', 'active'], s[3:])
  WHEN event = 'step_start' AND step IS NOT NULL THEN list_transform(range(1, 8), lambda i: CASE WHEN i <= step THEN 'complete' WHEN i = step + 1 THEN 'active' ELSE s[i] END)
  WHEN event = 'step_complete' AND step IS NOT NULL THEN list_transform(range(1, 8), lambda i: CASE WHEN i = step + 1 THEN 'complete' WHEN i = step + 2 AND s[i] = 'pending' THEN 'active' ELSE s[i] END)
  WHEN event = 'step_warning' AND step IS NOT NULL THEN list_transform(range(1, 8), lambda i: CASE WHEN i = step + 1 THEN 'warning' ELSE s[i] END)
  WHEN event = 'pipeline_complete' THEN list_transform(range(1, 8), lambda i: 'complete')
  WHEN event = 'pipeline_error' THEN list_transform(range(1, 8), lambda i: CASE WHEN i = list_position(s, 'active') THEN 'error' ELSE s[i] END) ELSE s END,
  ended OR event IN ('pipeline_complete', 'pipeline_error') FROM f JOIN x ON x.job_id = f.job_id AND x.n = f.n + 1),
folded AS (SELECT job_id, s, ended FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1)
"""
)


@query("st1_job_state", FOLD + "SELECT job_id, array_to_string(s, ',') AS statuses, ended FROM folded")
def st1(spark, sf_dir):
    return J.job_state(job_events(spark, sf_dir))


# Every kind of event, with the data that it has, by the event's number.
FEED = """WITH x AS (SELECT user_id AS job_id, ts, event_id AS seq, event_id % 24 AS kind, event_id AS i, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'said ' || i END AS said, repeat(t || ' ', 20) AS long, CASE k % 4 WHEN 0 THEN 'parse' WHEN 1 THEN 'mpn' ELSE 'search' END AS step FROM x),
f AS (SELECT job_id, ts, seq, CASE kind WHEN 1 THEN CASE WHEN k % 4 < 2 THEN step ELSE 'system' END WHEN 4 THEN 'model' WHEN 5 THEN 'model' WHEN 6 THEN 'model' WHEN 7 THEN 'model' WHEN 8 THEN 'search' WHEN 14 THEN 'search' WHEN 9 THEN 'pages' WHEN 10 THEN 'pages' WHEN 11 THEN 'pages' WHEN 12 THEN 'pages' ELSE 'system' END AS service,
  CASE kind WHEN 0 THEN 'PDF uploaded' WHEN 1 THEN coalesce(said, 'Starting ' || step) WHEN 2 THEN coalesce(said, 'Completed ' || step) WHEN 3 THEN coalesce(said, 'Warning') WHEN 4 THEN coalesce(said, upper(t) || ' request started') WHEN 5 THEN upper(t) || ' parsing chunk ' || k
    WHEN 6 THEN coalesce(said, upper(t) || ' finished') WHEN 7 THEN 'AI retry' WHEN 8 THEN 'Search' WHEN 9 THEN 'Scraping ' || t WHEN 10 THEN 'Page search (' || t || ')' WHEN 11 THEN 'Page credits exhausted' WHEN 12 THEN 'Page run complete' WHEN 13 THEN coalesce(said, 'API credit limit reached')
    WHEN 14 THEN 'Discovery for SKU ' || i WHEN 15 THEN 'SKU ' || i || ': ' || k || ' candidates shortlisted' WHEN 16 THEN 'Item ' || k || '/100 — SKU ' || i WHEN 17 THEN 'SKU ' || i || ' done' WHEN 18 THEN 'SKU ' || i || ' timed out (' || k || 's)' WHEN 19 THEN 'Equivalency: SKU ' || i WHEN 20 THEN 'Pipeline complete' WHEN 21 THEN coalesce(said, 'Error') END AS message,
  nullif(CASE kind WHEN 0 THEN t || '.pdf' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'Ref R' || i END WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 'SKU ' || i ELSE 'phase' END WHEN 5 THEN k || ' items' WHEN 7 THEN CASE WHEN k % 2 = 0 THEN 'SKU ' || i END WHEN 8 THEN left(long, 80) WHEN 9 THEN left('https://' || long, 70) WHEN 10 THEN k || ' results · ' || left(long, 50)
    WHEN 11 THEN k || ' scrapes · ' || i || ' credits' WHEN 12 THEN k || ' scrapes · ' || i || ' credits' WHEN 13 THEN said WHEN 14 THEN said WHEN 16 THEN left(long, 60) WHEN 17 THEN coalesce(said, k || ' candidates') WHEN 19 THEN t WHEN 20 THEN 'R' || i END, '') AS detail FROM m WHERE kind < 22)
"""
KINDS = ("upload_complete", "step_start", "step_complete", "step_warning", "model", "model", "model", "model", "search", "page", "page", "page_summary", "page_summary", "quota_limit", "discovery_start", "discovery_complete", "item_start", "item_complete", "item_timeout", "equivalency_found", "pipeline_complete", "pipeline_error", "unheard_of", "other")


@query("st2_activity_feed", FEED + "SELECT job_id, seq, service, message, detail, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS k FROM f QUALIFY k <= 200")
def st2(spark, sf_dir):
    i, k, t = F.col("event_id"), F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    kind = (i % 24).cast("int")
    said = F.when(k % 3 == 0, F.concat(F.lit("said "), i))
    long = F.repeat(F.concat(t, F.lit(" ")), F.lit(20))
    only = lambda value, *kinds: F.when(kind.isin(*kinds), value.cast("string"))
    even = lambda value: F.when(k % 2 == 0, value)
    action = F.get(F.array(F.lit("start"), F.lit("chunk"), F.lit("complete"), F.lit("retry"), F.lit(None), F.lit("scrape"), F.lit("find")), kind - 4)
    data = {
        "filename": only(F.concat(t, F.lit(".pdf")), 0), "step": F.when(k % 4 == 0, "parse").when(k % 4 == 1, "mpn").otherwise("search"), "message": only(said, 1, 2, 3, 4, 6, 13, 14, 21), "reference": F.when(kind == 20, F.concat(F.lit("R"), i)).otherwise(even(F.concat(F.lit("R"), i))),
        "action": only(action, *range(4, 11)), "provider": only(t, 4, 5, 6), "sku": F.when(kind.isin(4, 7), even(i)).otherwise(i), "phase": F.lit("phase"), "chunk": k, "items": k, "query": long, "site": t, "url": F.concat(F.lit("https://"), long), "stage": t, "results": k,
        "scrapes": k, "credits": i, "exhausted": kind == 11, "detail": said, "shortlisted": k, "index": k, "total": F.lit(100), "description": long, "best_exact": said, "candidates": k, "seconds": k, "level": t,
    }
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", i.alias("seq"), F.get(F.array(*map(F.lit, KINDS)), kind).alias("event"), F.to_json(F.struct(*(v.alias(n) for n, v in data.items()))).alias("data"))
    return J.activity_feed(e).select("job_id", "seq", "service", "message", "detail", F.col("k").cast("long").alias("k"))


@query("st3_quota_alerts", EVENTS + "SELECT job_id, service, seq FROM v WHERE event = 'quota_limit' QUALIFY row_number() OVER (PARTITION BY job_id, service ORDER BY ts, seq) = 1")
def st3(spark, sf_dir):
    return J.quota_alerts(job_events(spark, sf_dir)).select("job_id", "service", "seq")


@query("st4_rolling_usage", "SELECT event_id AS call_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events")
def st4(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("model"), "ts", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("tokens"))
    return J.rolling_usage(calls, 3600).select("call_id", "used")


@query(
    "st5_progress_percent",
    FOLD + "SELECT job_id, CAST(least(round(list_sum(list_transform(s, lambda x: CASE x WHEN 'complete' THEN 1.0 WHEN 'active' THEN 0.45 WHEN 'warning' THEN 0.8 ELSE 0.0 END)) / 7 * 100), 100) AS INTEGER) AS percent FROM folded",
)
def st5(spark, sf_dir):
    return J.progress_percent(J.job_state(job_events(spark, sf_dir)))


@query("st6_upsert_latest_event", EVENTS + "SELECT job_id, seq, event FROM v QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1")
def st6(spark, sf_dir):
    from ..operators.caches import upsert_latest

    e = job_events(spark, sf_dir).select("job_id", "ts", "seq", "event")
    return upsert_latest(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1"), ["job_id"], ["ts", "seq"]).select("job_id", "seq", "event")


@query(
    "st7_job_lifecycle",
    EVENTS
    + """, x AS (SELECT job_id, min(ts) AS started, min((ts, seq, event)) FILTER (event IN ('pipeline_complete', 'pipeline_error')) AS fin FROM v GROUP BY job_id)
SELECT job_id, started, CASE WHEN fin IS NULL THEN 'running' WHEN fin[3] = 'pipeline_complete' THEN 'complete' ELSE 'failed' END AS status, CAST(floor((epoch_us(fin[1]) - epoch_us(started)) / 1000000) AS BIGINT) AS seconds FROM x""",
)
def st7(spark, sf_dir):
    return J.lifecycle(job_events(spark, sf_dir)).select("job_id", "started", "status", "seconds")


@query(
    "st7_job_sessions",
    EVENTS
    + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM v),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, seq) AS part FROM g),
x AS (SELECT job_id, part, min(ts) AS started, max(ts) AS last, min((ts, seq, event)) FILTER (event IN ('pipeline_complete', 'pipeline_error')) AS fin FROM n GROUP BY ALL)
SELECT job_id, started, last, fin[1] AS ended, CAST(floor((epoch_us(coalesce(fin[1], last)) - epoch_us(started)) / 1000000) AS BIGINT) AS seconds, CASE WHEN fin IS NULL THEN 'silent' WHEN fin[3] = 'pipeline_complete' THEN 'complete' ELSE 'failed' END AS status FROM x""",
)
def st7_sessions(spark, sf_dir):
    return J.sessions(job_events(spark, sf_dir), "1 day").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "last", "ended")})


@query("a13_usage_summary", "SELECT user_id AS run_id, count(*) AS calls, count(*) FILTER (event_type = 'view') AS skipped, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS credits, bool_or(event_type = 'error' AND event_id % 40 = 0) AS exhausted FROM events GROUP BY 1")
def a13(spark, sf_dir):
    from ..operators.aggregates import usage_summary

    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("run_id"), (F.col("event_type") == "view").alias("skipped"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("credits"), ((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0)).alias("exhausted"))
    return usage_summary(calls)
