"""Progress state: message watermarks, content dedup, and a debounced counter, in batch and as streams.

The watermark counts messages, not event time: it says how far a transcript has been
read. A transcript that shrank starts over, and the mark moves even when nothing was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def new_messages(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages (t, raw_idx, ...) at or after their transcript's mark (t, message_count), of transcripts that grew."""
    size = F.count("*").over(Window.partitionBy("t"))
    rows = messages.withColumn("_n", size).join(marks, "t", "left").withColumn("_m", F.coalesce("message_count", F.lit(0)))
    return rows.where((F.col("_n") > F.col("_m")) & (F.col("raw_idx") >= F.col("_m"))).select(*messages.columns)


def next_marks(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks after a run: the current size of every transcript seen, else the old mark."""
    now = messages.groupBy("t").agg(F.count("*").alias("_n"))
    return marks.join(now, "t", "full").select("t", F.coalesce("_n", "message_count").alias("message_count"))


def count_steps(times: list[int], counts: list[int], total: int, fired: int | None, threshold: int, gap: int) -> tuple[list[tuple[int, int, bool]], int, int | None]:
    """Running count and whether it fires at each time; firing resets it, and waits keep it growing."""
    out = []
    for at, n in zip(times, counts, strict=True):
        total += n
        fire = total >= threshold and (fired is None or at - fired >= gap)
        out.append((at, total, fire))
        if fire:
            total, fired = 0, at
    return out, total, fired


def debounced(hits: DataFrame, threshold: int = 5, gap: int = 4 * 3600) -> DataFrame:
    """bank, at, total, fires of hits (bank, at in seconds, n); the state of each bank depends on the one before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby(["bank", "at"], as_index=False)["n"].sum().sort_values("at")
        steps, _, _ = count_steps(pdf["at"].tolist(), pdf["n"].tolist(), 0, None, threshold, gap)
        return pd.DataFrame([(pdf["bank"].iloc[0], *s) for s in steps], columns=["bank", "at", "total", "fires"])

    return hits.groupBy("bank").applyInPandas(run, "bank long, at long, total long, fires boolean")


class MessageProgress(StatefulProcessor):
    """Emits the messages of each transcript that its stored count has not covered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("message_count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("raw_idx", kind="stable")
        done = self.count.get()[0] if self.count.exists() else 0
        size = int(pdf["raw_idx"].max()) + 1
        if size < done:  # the file was replaced by a shorter one
            done = 0
        self.count.update((size,))
        yield pdf[pdf["raw_idx"] >= done].drop_duplicates("raw_idx")

    def close(self) -> None:
        pass


class ExpiringProgress(StatefulProcessor):
    """``MessageProgress`` whose state goes when a transcript has been idle for ``idle`` ms of event time.

    A timer deletes the state once the watermark has passed; a transcript that comes back before the timer has run, but after that time, starts over too, so
    results do not depend on how deliveries are cut into batches.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.progress = handle, handle.getValueState("progress", "n long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("raw_idx", kind="stable")
        first, last = (int(t.timestamp() * 1000) for t in (pdf["ts"].min(), pdf["ts"].max()))
        done, at = self.progress.get() if self.progress.exists() else (0, None)
        size = int(pdf["raw_idx"].max()) + 1
        if at is not None:
            self.handle.deleteTimer(at + self.idle)
            if first - at > self.idle or size < done:
                done = 0
        last = last if at is None else max(last, at)
        self.progress.update((size, last))
        self.handle.registerTimer(last + self.idle)
        yield pdf[pdf["raw_idx"] >= done].drop_duplicates("raw_idx")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.progress.clear()
        return iter(())

    def close(self) -> None:
        pass


class Debounce(StatefulProcessor):
    """Running total per bank that fires at a threshold, not before ``gap`` seconds after the last time; hits come in order of time, batch by batch."""

    def __init__(self, threshold: int, gap: int):
        self.threshold, self.gap = threshold, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "total long, fired long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a chunk of rows at a time; the state, not a frame, holds the bank's history
        hits: dict[int, int] = {}
        for pdf in rows:
            for at, n in zip(pdf["at"].tolist(), pdf["n"].tolist(), strict=True):
                hits[at] = hits.get(at, 0) + n
        total, fired = self.state.get() if self.state.exists() else (0, None)
        times = sorted(hits)
        steps, total, fired = count_steps(times, [hits[t] for t in times], total, fired, self.threshold, self.gap)
        self.state.update((total, fired))
        yield pd.DataFrame([(key[0], *x) for x in steps], columns=["bank", "at", "total", "fires"])

    def close(self) -> None:
        pass


def stream_debounced(hits: DataFrame, threshold: int = 5, gap: int = 4 * 3600) -> DataFrame:
    """bank, at, total, fires of a stream of hits (bank, at in seconds, n). Needs the RocksDB state store."""
    return hits.groupBy("bank").transformWithStateInPandas(statefulProcessor=Debounce(threshold, gap), outputStructType="bank long, at long, total long, fires boolean", outputMode="append", timeMode="none")


def size_gate(batch: DataFrame, recorded: DataFrame) -> DataFrame:
    """(t, size) of the batch's transcripts that are larger than recorded (t, recorded); others have nothing new."""
    return batch.join(recorded, "t", "left").where(F.col("size") > F.coalesce("recorded", F.lit(0))).select("t", "size")


def stream_new_messages(stream: DataFrame) -> DataFrame:
    """A stream of (t, raw_idx, ...) in which each delivery holds whole transcripts, to the messages not seen yet.

    Needs the RocksDB state store.
    """
    return stream.groupBy("t").transformWithStateInPandas(statefulProcessor=MessageProgress(), outputStructType=stream.schema, outputMode="append", timeMode="none")


def stream_new_messages_expiring(stream: DataFrame, days: int = 7, late: str = "0 seconds") -> DataFrame:
    """``stream_new_messages`` of (t, raw_idx, ts, ...) that forgets transcripts after ``days`` idle days: those are read from message 0 again.

    Needs the RocksDB state store.
    """
    rows = stream.withWatermark("ts", late)
    return rows.groupBy("t").transformWithStateInPandas(statefulProcessor=ExpiringProgress(days * 86_400_000), outputStructType=stream.schema, outputMode="append", timeMode="eventTime")


def watch(spark: SparkSession, path: str, schema: str, fmt: str = "json", pattern: str | None = None) -> DataFrame:
    """Stream of new files below a folder."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(fmt).load(path)


def run_available(df: DataFrame, sink, checkpoint: str) -> None:
    """Processes what is there, in batches, into ``sink(batch, id)``, and ends."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retried(items: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """(delivered, backlog): rows for which ``ok`` holds, and those to replay."""
    return items.where(ok), items.where(~F.coalesce(ok, F.lit(False)))
