"""Streams against their batch twins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidscout.operators.caches import upsert_latest
from bidscout.plans.stream_jobs import as_job_events
from bidscout.streaming import jobs as J


def replay(spark, sf, tmp_path, parts=3):
    """The events as a stream of files in time order."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    part = events.withColumn("part", F.ntile(parts).over(Window.orderBy("ts")))
    for k in range(1, parts + 1):
        part.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_job_state(spark, sf, tmp_path):
    events, stream = replay(spark, sf, tmp_path)
    last = {}
    for r in run(J.job_state_stream(as_job_events(stream)), "job_state", "update", tmp_path):
        last[r.job_id] = (r.statuses, r.ended)
    assert last == {r.job_id: (r.statuses, r.ended) for r in J.job_state(as_job_events(events)).collect()}


def test_quota_alerts(spark, sf, tmp_path):
    events, stream = replay(spark, sf, tmp_path)
    got = run(J.quota_alerts_stream(as_job_events(stream).withColumn("ts", F.col("ts").cast("timestamp"))), "quota_alerts", "append", tmp_path)
    want = {(r.job_id, r.service) for r in J.quota_alerts(as_job_events(events)).collect()}
    assert {(r.job_id, r.service) for r in got} == want


def test_usage(spark, sf, tmp_path):
    events, stream = replay(spark, sf, tmp_path)
    calls = lambda df: df.select(F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("tokens"))
    got = run(J.usage_stream(calls(stream)), "usage", "update", tmp_path)
    assert sum(r.used for r in {(r.window.start, r.model): r for r in got}.values()) == 12 * events.count()


def test_upserts(spark, sf, tmp_path):
    events, stream = replay(spark, sf, tmp_path)
    keep = ["user_id", "event_id", "event_type"]
    q = J.upsert_batches(stream.select(*keep), f"{tmp_path}/table", ["user_id"], ["event_id"]).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = J.upserted(spark, f"{tmp_path}/table")
    want = upsert_latest(events.select(*keep).limit(0), events.select(*keep), ["user_id"], ["event_id"])
    assert last.select(*keep).exceptAll(want.select(*keep)).isEmpty() and last.count() == want.count()


class Sink:
    """Catches what upsert_batches does with a batch, so that batches can be run one by one, and again."""

    def __init__(self):
        self.writeStream = self

    def foreachBatch(self, merge):
        return merge


def files_of(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_fifty_batches(spark, tmp_path, monkeypatch):
    """Runs, files and manifests stay few, every batch is seen whole, and a batch that is run again changes nothing."""
    monkeypatch.setattr(J, "FILE_ROWS", 40)
    table = tmp_path / "t"
    merge = J.upsert_batches(Sink(), str(table), ["k"], ["ts"])
    want = {}
    most = 0
    for n in range(50):
        rows = [((n * 7 + i) % 97, n * 10 + i, f"v{n}") for i in range(8)] if n % 10 != 9 else []
        batch = spark.createDataFrame(rows, "k long, ts long, v string")
        merge(batch, n)
        want |= {k: (ts, v) for k, ts, v in rows}
        if n % 8 == 0:
            merge(batch, n)
            assert {r.k: (r.ts, r.v) for r in J.upserted(spark, str(table)).collect()} == want
        most = max(most, len({f.split("/")[0] for f in files_of(table) if f.startswith("run-")}))
    assert {r.k: (r.ts, r.v) for r in J.upserted(spark, str(table)).collect()} == want and len(want) == 97
    assert most <= 2 * J.FANOUT * 3 and len([f for f in files_of(table) if f.startswith("log")]) == J.KEPT
    newest = max((f for f in files_of(table) if f.startswith("run-")), key=lambda f: int(f.split("/")[0].split("-")[2]))
    assert len([f for f in files_of(table) if f.startswith(newest.split("/")[0])]) >= 2  # a larger run has more files


def test_a_batch_that_breaks_off_is_not_seen(spark, tmp_path):
    table = tmp_path / "t"
    merge = J.upsert_batches(Sink(), str(table), ["k"], ["ts"])
    merge(spark.createDataFrame([(1, 1)], "k long, ts long"), 0)
    spark.createDataFrame([(1, 9)], "k long, ts long").write.parquet(f"{table}/run-1-0")  # written, but no manifest
    assert [r.ts for r in J.upserted(spark, str(table)).collect()] == [1]
    merge(spark.createDataFrame([(1, 2)], "k long, ts long"), 1)
    assert [r.ts for r in J.upserted(spark, str(table)).collect()] == [2]


def test_sessions(spark, tmp_path):
    """Silent jobs are closed by the watermark, late rows within it still count, those beyond it are dropped; as in the batch twin."""
    at = lambda m: f"2026-01-01 {m // 60:02}:{m % 60:02}:00"
    rows = [  # by batch: job, minute, seq, event
        [(1, 0, 1, "upload_complete"), (2, 1, 2, "upload_complete"), (1, 12, 3, "step_start")],
        [(1, 6, 4, "step_complete"), (1, 14, 5, "pipeline_complete"), (3, 20, 6, "upload_complete")],  # minute 6 is late, and counts
        [(3, 31, 7, "pipeline_error"), (2, 100, 8, "step_start")],  # job 2 was silent: another stretch
        [(5, 200, 9, "upload_complete")],
        [(4, 5, 10, "upload_complete")],  # job 4 is beyond the watermark
        [(6, 400, 11, "upload_complete")],
    ]
    kinds = "job_id long, ts timestamp, seq long, event string"
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(j, at(m), q, e) for j, m, q, e in part], "job_id long, ts string, seq long, event string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(J.sessions(stream.drop("b"), "30 minutes"), "sessions", "append", tmp_path)
    of = lambda rs: sorted((r.job_id, r.started.hour * 60 + r.started.minute, r.seconds, r.status) for r in rs)
    assert of(got) == [(1, 0, 840, "complete"), (2, 1, 0, "silent"), (2, 100, 0, "silent"), (3, 20, 660, "failed"), (5, 200, 0, "silent")]
    every = of(J.sessions(spark.read.parquet(f"{tmp_path}/in")).collect())
    assert set(of(got)) < set(every) and [x for x in every if x not in of(got)] == [(4, 5, 0, "silent"), (6, 400, 0, "silent")]


def test_feed(spark):
    rows = [(1, "model", '{"action": "start", "provider": "x", "phase": "one"}'), (2, "model", '{"action": "odd", "sku": 7}'), (3, "page_summary", '{"exhausted": true, "scrapes": 2, "credits": 9}'), (4, "step_start", '{"step": "mpn"}'), (5, "unknown", "{}"), (6, "pipeline_error", None), (7, "search", "not json"), (8, "step_complete", '{"message": null, "step": "s", "reference": "R"}')]
    df = spark.createDataFrame([(1, i, i, e, d) for i, e, d in rows], "job_id long, ts long, seq long, event string, data string")
    got = {r.seq: (r.service, r.message, r.detail) for r in J.activity(df).collect()}
    assert got == {
        1: ("model", "X request started", "one"), 2: ("model", "AI odd", "SKU 7"), 3: ("pages", "Page credits exhausted", "2 scrapes · 9 credits"), 4: ("mpn", "Starting mpn", None),
        6: ("system", "Error", None), 7: ("search", "Search", None), 8: ("system", "Completed s", "Ref R"),
    }
