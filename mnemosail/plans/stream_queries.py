"""Streams over the driver's tables, run to the end in batches; each equals its batch oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources import readers as IO
from ..sources.changed_files import changed_files
from ..sources.keyed_table import KeyedTable
from ..streaming.progress import retried, run_available, size_gate, stream_debounced, stream_new_messages, stream_new_messages_expiring
from .inputs import Inputs
from .registry import query
from .rollup_queries import DAILY, daily


def scratch(i: Inputs) -> str:
    """A new folder in what driver and executors share."""
    return files.scratch(i.spark, "query")


def source(i: Inputs, table: str) -> DataFrame:
    """The table's files as a stream of files, be it one file or a folder of them; as a pattern, for a stream's plain path has to be a folder."""
    return i.spark.readStream.schema(i.table(table).schema).parquet(f"{i.dir}/{{{table}.parquet}}")


def collected(i: Inputs, stream: DataFrame, transform=lambda b: b) -> DataFrame:
    """What the stream delivers, as a table written batch by batch (a repeated batch replaces itself)."""
    at = scratch(i)

    def sink(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    run_available(stream, sink, f"{at}/progress")
    return i.spark.read.schema(transform(i.spark.createDataFrame([], stream.schema)).schema).parquet(f"{at}/out").drop("batch")


def publish(i: Inputs, rows: DataFrame, root: str, parts: int) -> None:
    """Rows as JSON lines, in files ``part-<k>.json`` that are replaced where they exist; ``rows`` names its part."""
    staged = f"{scratch(i)}/staged"
    rows.select("part", F.to_json(F.struct(*[c for c in rows.columns if c != "part"])).alias("value")).repartition(parts, "part").write.partitionBy("part").text(staged)
    for folder in files.folder_names(i.spark, staged):  # parts at most
        for name in files.folder_names(i.spark, f"{staged}/{folder}"):
            if folder.startswith("part=") and name.startswith("part-"):
                files.move(i.spark, f"{staged}/{folder}/{name}", f"{root}/part-{folder[5:]}.json")


def live(i: Inputs, *versions: DataFrame, parts: int = 4) -> DataFrame:
    """What the files of a folder hold after the last version, as a stream of changed files has delivered it: each file as delivered last."""
    at = scratch(i)

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    for rows in versions:
        publish(i, rows, f"{at}/in", parts)
        run_available(changed_files(i.spark, f"{at}/in", f"{at}/listings", pattern="*.json"), sink, f"{at}/progress")
    got = i.spark.read.parquet(f"{at}/out")
    last = got.groupBy("path").agg(F.max("batch").alias("batch"))
    return got.join(last, ["path", "batch"]).select(F.from_json("value", versions[0].drop("part").schema).alias("r")).select("r.*")


@query("scan_walk_dir_live", "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN url || '?changed' ELSE url END AS url FROM pages")
def _(i: Inputs):
    pages = i.table("pages").select("page_id", "url", (F.col("page_id") % 4).alias("part"))
    # one of four files changes in place
    return live(i, pages, pages.where("part = 1").withColumn("url", F.concat("url", F.lit("?changed"))))


@query("stream_live_files", "SELECT event_type, count(*) AS n FROM events WHERE NOT (event_id % 4 = 2 AND event_id % 3 = 1) GROUP BY 1")
def _(i: Inputs):
    events = i.table("events").select("event_id", "event_type", (F.col("event_id") % 4).alias("part"))
    # a file grows, then another shrinks; each is delivered again, whole
    got = live(i, events.where("part <> 1 or event_id % 3 = 0"), events.where("part = 1"), events.where("part = 2 and event_id % 3 <> 1"))
    return got.groupBy("event_type").agg(F.count("*").alias("n"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(i: Inputs, run):
    """What ``run`` returns, under the state store that stateful processors need; the session's own comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = i.spark.conf.get(key, None)
    i.spark.conf.set(key, ROCKS)
    try:
        return run()
    finally:
        i.spark.conf.set(key, before) if before else i.spark.conf.unset(key)


def deliveries(i: Inputs, *parts: DataFrame, transform=lambda b: b, stream=lambda s: s) -> DataFrame:
    """What a stream of files delivers, run to its end after each part has come in, under one checkpoint."""
    at = scratch(i)

    def sink(batch: DataFrame, n: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        run_available(stream(i.spark.readStream.schema(part.schema).parquet(f"{at}/in")), sink, f"{at}/progress")
    return i.spark.read.parquet(f"{at}/out").drop("batch")


def messages(i: Inputs) -> DataFrame:
    return i.table("conversations").select(F.col("conv_id").alias("t"), F.col("turn").alias("raw_idx"))


@query("stream_new_messages", "SELECT conv_id AS t, turn AS raw_idx FROM conversations")
def _(i: Inputs):
    return with_state(i, lambda: collected(i, stream_new_messages(source(i, "conversations").select(F.col("conv_id").alias("t"), F.col("turn").alias("raw_idx")))))


@query("stream_message_watermark", "SELECT conv_id AS t, count(*) AS message_count FROM conversations GROUP BY 1")
def _(i: Inputs):
    # the second delivery holds whole transcripts again; the state lets only new messages through
    new = with_state(i, lambda: deliveries(i, messages(i).where("raw_idx < 2"), messages(i), stream=stream_new_messages))
    return new.groupBy("t").agg(F.count("*").alias("message_count"))


@query("stream_size_gate", "SELECT conv_id AS t FROM (SELECT conv_id, sum(length(text)) AS size FROM conversations GROUP BY 1) WHERE size > (conv_id%5)*300")
def _(i: Inputs):
    recorded = i.table("conversations").select(F.col("conv_id").alias("t"), (F.col("conv_id") % 5 * 300).alias("recorded")).distinct()
    at = scratch(i)
    files.replace_table(recorded, at)

    def gate(batch: DataFrame) -> DataFrame:
        return size_gate(batch.groupBy("t").agg(F.sum("size").alias("size")), files.current_table(i.spark, at))

    said = i.table("conversations").select(F.col("conv_id").alias("t"), F.length("text").alias("size"))
    return deliveries(i, said, transform=gate).select("t")


@query("stream_state_ttl", """WITH n AS (SELECT conv_id AS t, count(*) AS n FROM conversations GROUP BY 1)
SELECT t, CASE WHEN t % 3 = 0 THEN n ELSE least(n, 2) + n END AS delivered FROM n""")
def _(i: Inputs):
    said = messages(i)

    def on(day: int, rows: DataFrame) -> DataFrame:
        return rows.withColumn("ts", F.to_timestamp(F.lit(f"2024-01-{day:02} 00:00:00")))

    # a third comes back after 3 and again after 5 idle days and is read on, the others after 9 and are read from message 0 again
    parts = on(1, said.where("raw_idx < 2")), on(4, said.where("t % 3 = 0")), on(9, said.where("t % 3 = 0")), on(10, said)
    got = with_state(i, lambda: deliveries(i, *parts, stream=stream_new_messages_expiring))
    return got.groupBy("t").agg(F.count("*").alias("delivered"))


@query("stream_poll_issues", "SELECT source, count(*) AS n FROM (SELECT DISTINCT doc_id, source FROM documents) GROUP BY 1")
def _(i: Inputs):
    d = i.table("documents").select("doc_id", "source", F.lit(1).alias("version"))
    target = KeyedTable.create(i.spark, scratch(i), d.schema, "doc_id", "version", 16)

    def merge(batch: DataFrame) -> DataFrame:
        target.upsert(batch)
        return batch

    # every poll fetches everything again; ids make it idempotent
    deliveries(i, d, d.withColumn("version", F.lit(2)), transform=merge)
    return target.rows().groupBy("source").agg(F.count("*").alias("n"))


@query("stream_hourly_vs_nightly", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-30 22:00:00'")
def _(i: Inputs):
    end = F.to_timestamp(F.lit("2024-01-30 22:00:00"))

    def lookback(hours: int):
        return lambda b: b.where((F.col("ts") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") < end))

    events = source(i, "events").select("event_id", "ts")
    hourly, nightly = (collected(i, events, lookback(h)).select("event_id") for h in (2, 24))
    return hourly.unionByName(nightly.join(hourly, "event_id", "left_anti"))


@query("stream_retry_buffer", "SELECT event_id, event_id%25<>0 AS delivered FROM events WHERE event_type='click'")
def _(i: Inputs):
    backlog = scratch(i)

    def deliver(ok):
        def run(batch: DataFrame) -> DataFrame:
            done, rest = retried(batch, ok)
            files.replace_table(rest, backlog)  # what failed, and nothing else, is replayed
            return done

        return run

    clicks = i.table("events").where("event_type = 'click'").select("event_id")
    first = deliveries(i, clicks, transform=deliver(F.col("event_id") % 5 != 0))
    again = deliveries(i, files.current_table(i.spark, backlog), transform=deliver(F.col("event_id") % 25 != 0))
    done = first.unionByName(again).withColumn("delivered", F.lit(True))
    return done.unionByName(files.current_table(i.spark, backlog).withColumn("delivered", F.lit(False)))


@query("stream_backfill_range", f"WITH {DAILY} SELECT day, project, CASE WHEN day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN sessions*2 ELSE sessions END AS sessions FROM daily")
def _(i: Inputs):
    at, rows = scratch(i), daily(i).select("day", "project", "sessions")
    IO.replace_partitions(rows, at, "day")
    again = rows.where(F.col("day").between(F.to_date(F.lit("2024-01-10")), F.to_date(F.lit("2024-01-12")))).withColumn("sessions", F.col("sessions") * 2)
    IO.replace_partitions(again, at, "day")  # the days of the range, and no others
    return i.spark.read.schema(rows.schema).parquet(at).select("day", "project", "sessions")


@query("stream_debounce")
def _(i: Inputs):
    hits = i.table("events").select(F.col("user_id").alias("bank"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("n"))
    half = F.unix_seconds(F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return with_state(i, lambda: deliveries(i, hits.where(F.col("at") < half), hits.where(F.col("at") >= half), stream=stream_debounced))
