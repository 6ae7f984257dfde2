"""Progress of jobs from an event stream: state, feed, alerts, usage, lifecycle.

Events are rows (job_id, ts, seq, event, step int, service string, message string, data string: a JSON object).
Each job on a stream has a batch twin over the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.caches import upsert_latest

STEPS = ("upload", "parse", "enrich", "search", "match", "equivalency", "reports")
WATERMARK = "10 minutes"
STATE = "job_id long, statuses string, ended boolean"


def after(statuses: list[str], event: str, step: int | None) -> list[str]:
    """The statuses of the steps after an event."""
    s = list(statuses)
    if event == "upload_complete":
        s[0], s[1] = "complete", "active"
    elif event == "step_start" and step is not None:
        s = ["complete"] * step + ["active"] + s[step + 1 :]
    elif event == "step_complete" and step is not None:
        s[step] = "complete"
        if step + 1 < len(s) and s[step + 1] == "pending":
            s[step + 1] = "active"
    elif event == "step_warning" and step is not None:
        s[step] = "warning"
    elif event == "pipeline_complete":
        s = ["complete"] * len(s)
    elif event == "pipeline_error" and "active" in s:
        s[s.index("active")] = "error"
    return s


def _fold(state: Column, e: Column) -> Column:
    """after(), as a column; an event after the end of a job changes nothing."""
    s, k = state["s"], e["step"]
    n = len(STEPS)
    each = lambda f: F.transform(s, f)
    start = each(lambda x, i: F.when(i < k, "complete").when(i == k, "active").otherwise(x))
    done = each(lambda x, i: F.when(i == k, "complete").when((i == k + 1) & (x == "pending"), "active").otherwise(x))
    upload = each(lambda x, i: F.when(i == 0, "complete").when(i == 1, "active").otherwise(x))
    broken = each(lambda x, i: F.when(i + 1 == F.array_position(s, "active"), "error").otherwise(x))
    new = (
        F.when(state["ended"], s)
        .when(e["event"] == "upload_complete", upload)
        .when((e["event"] == "step_start") & k.isNotNull(), start)
        .when((e["event"] == "step_complete") & k.isNotNull(), done)
        .when((e["event"] == "step_warning") & k.isNotNull(), each(lambda x, i: F.when(i == k, "warning").otherwise(x)))
        .when(e["event"] == "pipeline_complete", F.array_repeat(F.lit("complete"), n))
        .when(e["event"] == "pipeline_error", broken)
        .otherwise(s)
    )
    return F.struct(new.alias("s"), (state["ended"] | e["event"].isin("pipeline_complete", "pipeline_error")).alias("ended"))


def job_state(events: DataFrame) -> DataFrame:
    """job_id, statuses (of the steps, joined by commas), ended: the fold of a job's events in time order."""
    row = F.struct("ts", "seq", "event", "step")
    jobs = events.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.struct(F.array_repeat(F.lit("pending"), len(STEPS)).alias("s"), F.lit(False).alias("ended"))
    return jobs.withColumn("state", F.aggregate("rows", none, _fold)).select("job_id", F.array_join("state.s", ",").alias("statuses"), "state.ended")


def job_state_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: one state of a job, cleared when it ends; needs the RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "statuses string, ended boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = self.state.get() if self.state.exists() else (",".join(["pending"] * len(STEPS)), False)
            statuses, ended = held[0].split(","), held[1]
            batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
            for event, step in zip(batch["event"], batch["step"], strict=True):
                if ended:
                    break
                statuses = after(statuses, event, None if pd.isna(step) else int(step))
                ended = event in ("pipeline_complete", "pipeline_error")
            self.state.update((",".join(statuses), bool(ended)))
            yield pd.DataFrame({"job_id": [key[0]], "statuses": [",".join(statuses)], "ended": [bool(ended)]})

        def close(self) -> None:
            pass

    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=STATE, outputMode="Update", timeMode="None")


def progress_percent(state: DataFrame) -> DataFrame:
    """job_id, percent: complete steps count 1, active 0.45, with a warning 0.8."""
    weight = F.aggregate(
        F.split("statuses", ","),
        F.lit(0.0),
        lambda a, s: a + F.when(s == "complete", 1.0).when(s == "active", 0.45).when(s == "warning", 0.8).otherwise(0.0),
    )
    return state.select("job_id", F.least(F.round(weight / len(STEPS) * 100), F.lit(100.0)).cast("int").alias("percent"))


# What the feed says of each kind of event, by the action in its data: service, message, detail.
# {field} is a field of the data, {field:n} its first n characters; | parts wordings, of which the first
# whose fields are all there is taken, else the last.
FEED = (
    ("upload_complete", None, "system", "PDF uploaded", "{filename}"),
    ("step_start", None, None, "{label}|{message}|Starting {step}", ""),
    ("step_complete", None, "system", "{message}|Completed {step}", "Ref {reference}|"),
    ("step_warning", None, "system", "{message}|Warning", ""),
    ("model", "start", "model", "{message}|{provider} request started", "SKU {sku}|{phase}"),
    ("model", "chunk", "model", "{provider} parsing chunk {chunk}", "{items} items"),
    ("model", "complete", "model", "{message}|{provider} finished", ""),
    ("model", None, "model", "{provider} {action}", "SKU {sku}|"),
    ("search", None, "search", "Search", "{query:80}"),
    ("page", "scrape", "pages", "Scraping {site}", "{url:70}"),
    ("page", None, "pages", "Page search ({stage})", "{results} results · {query:50}"),
    ("page_summary", "exhausted", "pages", "Page credits exhausted", "{scrapes} scrapes · {credits} credits"),
    ("page_summary", None, "pages", "Page run complete", "{scrapes} scrapes · {credits} credits"),
    ("quota_limit", None, "system", "{message}|API credit limit reached", "{detail}"),
    ("discovery_start", None, "search", "Discovery for SKU {sku}", "{message}"),
    ("discovery_complete", None, "system", "SKU {sku}: {shortlisted} candidates shortlisted", ""),
    ("item_start", None, "system", "Item {index}/{total} — SKU {sku}", "{description:60}"),
    ("item_complete", None, "system", "SKU {sku} done", "{best_exact}|{candidates} candidates"),
    ("item_timeout", None, "system", "SKU {sku} timed out ({seconds}s)", ""),
    ("equivalency_found", None, "system", "Equivalency: SKU {sku}", "{level}"),
    ("pipeline_complete", None, "system", "Pipeline complete", "{reference}"),
    ("pipeline_error", None, "system", "{message}|Error", ""),
)
#: Steps whose start is the activity of a service of their own.
STEP_SERVICES = ("parse", "mpn")


PARTS = "array<array<struct<text:string,field:string,most:int>>>"


def feed_templates(spark: SparkSession) -> DataFrame:
    """FEED as a table: key (event, or event/action), service, message and detail (wordings of parts)."""

    def wordings(said: str) -> list:
        cut = [re.findall(r"([^{]*)(?:\{(\w+):?(\d*)\})?", wording) for wording in said.split("|")]
        return [[(text, field, int(most or 1 << 30)) for text, field, most in parts if text or field] for parts in cut]

    rows = [(event if action is None else f"{event}/{action}", service, wordings(message), wordings(detail)) for event, action, service, message, detail in FEED]
    return spark.createDataFrame(rows, f"key string, service string, message {PARTS}, detail {PARTS}")


def _filled(wordings: str, data: Column) -> Column:
    """The first wording whose fields are all there, else the last, with the fields of data (map)."""
    value = lambda p: F.try_element_at(data, p["field"])
    whole = F.filter(wordings, lambda w, i: (i == F.size(wordings) - 1) | F.forall(w, lambda p: (p["field"] == "") | value(p).isNotNull()))
    return F.array_join(F.transform(F.get(whole, 0), lambda p: F.concat(p["text"], F.coalesce(F.left(value(p), p["most"]), F.lit("")))), "")


def activity(events: DataFrame) -> DataFrame:
    """events (job_id, ts, seq, event, data: a JSON object) -> job_id, ts, seq, service, message, detail (null: none).

    Stateless: a join with the few rows of FEED, by the kind of event and its action; other kinds say nothing.
    """
    given = F.coalesce(F.from_json("data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    df = events.select("job_id", "ts", "seq", "event", given.alias("given"))
    provider = F.create_map(F.lit("provider"), F.upper(F.coalesce(F.try_element_at("given", F.lit("provider")), F.lit("AI"))))
    df = df.withColumn("data", F.map_concat(F.map_filter("given", lambda k, _: k != "provider"), provider))
    field = lambda name: F.try_element_at("data", F.lit(name))
    action = F.when(F.col("event") == "page_summary", F.when(field("exhausted") == "true", "exhausted")).otherwise(field("action"))
    known = [f"{event}/{act}" for event, act, *_ in FEED if act]
    both = F.concat("event", F.lit("/"), action)
    df = df.withColumn("key", F.when(both.isin(known), both).otherwise(F.col("event")))
    df = df.join(F.broadcast(feed_templates(events.sparkSession)), "key")  # as many rows as FEED has
    service = F.coalesce("service", F.when(field("step").isin(*STEP_SERVICES), field("step")).otherwise("system"))
    return df.select("job_id", "ts", "seq", service.alias("service"), _filled("message", F.col("data")).alias("message"), F.nullif(_filled("detail", F.col("data")), F.lit("")).alias("detail"))


def activity_feed(events: DataFrame, most: int = 200) -> DataFrame:
    """The last rows of each job's activity; a top-k, which Spark limits before its shuffle."""
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq"))
    return activity(events).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)


def alerts(events: DataFrame) -> DataFrame:
    """Events that say a service's quota is used up."""
    said = F.rlike(F.lower(F.coalesce("message", F.lit(""))), F.lit(r"quota|rate limit|credits? exhausted|429"))
    return events.filter((F.col("event") == "quota_limit") | said).select("job_id", "ts", "seq", "service")


def quota_alerts(events: DataFrame) -> DataFrame:
    """The first alert of each job and service."""
    return alerts(events).groupBy("job_id", "service").agg(F.min(F.struct("ts", "seq")).alias("at")).select("job_id", "service", "at.ts", "at.seq")


def quota_alerts_stream(events: DataFrame) -> DataFrame:
    return alerts(events).withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["job_id", "service"])


def rolling_usage(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """calls (call_id, model, ts, tokens) with used: the model's tokens in the last seconds, this call included.

    A model is cut into stretches of that length, so that one busy model is many
    groups; each row also goes to the stretch after its own, where it is looked back at.
    """
    stretch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    df = calls.withColumn("own", stretch).withColumn("stretch", F.explode(F.array("own", F.col("own") + 1)))
    w = Window.partitionBy("model", "stretch").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("used", F.sum("tokens").over(w)).filter("own = stretch").drop("own", "stretch")


def usage_stream(calls: DataFrame) -> DataFrame:
    """On a stream: tokens of each model in sliding windows of a minute."""
    return calls.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "60 seconds", "5 seconds"), "model").agg(F.sum("tokens").alias("used"))


def lifecycle(events: DataFrame) -> DataFrame:
    """job_id, started, ended, seconds, status: from the first event to the first that ends the job."""
    end = F.col("event").isin("pipeline_complete", "pipeline_error")
    df = events.groupBy("job_id").agg(F.min("ts").alias("started"), F.min(F.when(end, F.struct("ts", "seq", "event"))).alias("end"))
    status = F.when(F.col("end.event") == "pipeline_complete", "complete").when(F.col("end.event") == "pipeline_error", "failed").otherwise("running")
    return df.select("job_id", "started", F.col("end.ts").alias("ended"), F.floor((F.unix_micros(F.col("end.ts").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000).alias("seconds"), status.alias("status"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """job_id, started, last, ended, seconds, status of each stretch of a job's events without a gap, on a stream or not.

    A stretch is complete or failed by its first event that ends a job; one that fell silent is `silent`. On a
    stream it is given out once the watermark is a gap beyond its last event; what comes later than that is dropped.
    """
    end = F.col("event").isin("pipeline_complete", "pipeline_error")
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", WATERMARK) if df.isStreaming else df
    df = df.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.min(F.when(end, F.struct("ts", "seq", "event"))).alias("end"))
    status = F.when(F.col("end.event") == "pipeline_complete", "complete").when(F.col("end.event") == "pipeline_error", "failed").otherwise("silent")
    seconds = F.floor((F.unix_micros(F.coalesce("end.ts", "last")) - F.unix_micros("started")) / 1_000_000)
    return df.select("job_id", "started", "last", F.col("end.ts").alias("ended"), seconds.alias("seconds"), status.alias("status"))


# A table kept by batches ---------------------------------------------------

#: Runs of one level that are merged into one of the next; manifests that stay readable; rows in a file of a run.
FANOUT, KEPT, FILE_ROWS = 4, 2, 1_000_000
MANIFEST = "runs array<struct<name:string,level:int>>, key array<string>, order array<string>"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, v long").parquet(f"{path}/log")


def _folders(spark: SparkSession, path: str):
    """The file system of path, and its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _latest(spark: SparkSession, path: str, before: int | None = None):
    """The newest manifest (of a batch before a number); None if there is none."""
    fs, log = _folders(spark, f"{path}/log")
    if not fs.exists(log):
        return None
    found = _manifests(spark, path)
    found = found if before is None else found.filter(F.col("v") < before)
    rows = found.orderBy(F.desc("v")).limit(1).collect()
    return rows[0] if rows else None


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_batches keeps at path, as of its last whole batch: the last row of each key in any run."""
    at = _latest(spark, path)
    if at is None:
        raise ValueError(f"no batch has been written to {path}")
    return _merged(spark, path, [r["name"] for r in at["runs"]], at["key"], at["order"])


def _merged(spark: SparkSession, path: str, names: list[str], key: list[str], order: list[str]) -> DataFrame:
    rows = spark.read.parquet(*(f"{path}/{n}" for n in names))
    return upsert_latest(rows.filter(F.lit(False)), rows, list(key), list(order))


def upsert_batches(updates: DataFrame, path: str, key: list[str], order: list[str]):
    """A sink for ST6: each micro-batch's last rows merged into a table by key. Returns the stream's writer.

    A batch is written as a run of its own, and when FANOUT runs of a level are there they are merged into one of
    the next, so that a row is rewritten once a level and runs are few (FANOUT a level at most, levels grow with the
    logarithm of the batches); a run has a file for each FILE_ROWS rows, so files split as the table grows. A
    manifest of one file names the runs of a batch and is written last: readers see whole batches only, and a batch
    that is run again gives the same. Runs and manifests older than the last KEPT batches are deleted.
    """

    held: dict[int, list[tuple[str, int]]] = {}  # the manifests that this sink has written, by batch

    def write(df: DataFrame, name: str) -> None:
        df = df.persist()
        files = max(1, -(-df.count() // FILE_ROWS))
        df.repartition(files, *key).write.mode("overwrite").parquet(f"{path}/{name}")
        df.unpersist()

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number - 1 not in held and (found := _latest(spark, path, number)):
            held[found["v"]] = [(r["name"], r["level"]) for r in found["runs"]]
        runs = list(held[max(v for v in held if v < number)]) if any(v < number for v in held) else []
        if not runs or not batch.isEmpty():
            write(upsert_latest(batch.filter(F.lit(False)), batch, key, order), f"run-{number}-0")
            runs.append((f"run-{number}-0", 0))
        while len(runs) >= FANOUT and len({level for _, level in runs[-FANOUT:]}) == 1:
            level = runs[-1][1] + 1
            write(_merged(spark, path, [n for n, _ in runs[-FANOUT:]], key, order), f"run-{number}-{level}")
            runs = [*runs[:-FANOUT], (f"run-{number}-{level}", level)]
        spark.createDataFrame([(runs, key, order)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/v={number}")
        held[number] = runs
        drop_old(spark, number)

    def drop_old(spark: SparkSession, number: int) -> None:
        fs, folder = _folders(spark, path)
        of = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        versions = sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(of("log")) if f.getPath().getName().startswith("v="))
        kept = [v for v in versions if v <= number][-KEPT:]
        if any(v not in held for v in kept):
            held.update({r["v"]: [(x["name"], x["level"]) for x in r["runs"]] for r in _manifests(spark, path).collect()})  # KEPT + 1 rows
        live = {name for v in kept for name, _ in held[v]}
        for v in [v for v in versions if v < kept[0]]:
            fs.delete(of(f"log/v={v}"), True)
            held.pop(v, None)
        for f in fs.listStatus(folder):
            name = f.getPath().getName()
            if name.startswith("run-") and name not in live and int(name.split("-")[1]) <= number:
                fs.delete(f.getPath(), True)

    return updates.writeStream.foreachBatch(merge)
