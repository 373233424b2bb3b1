"""Snapshot feeds as Structured Streaming: a frame a micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merging import renderable
from ..sources import snapshots


def frames(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Frames of a folder of Parquet snapshots, so many files a trigger (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def replay(spark: SparkSession, path: str, columns: str, form: str = "columnar", loop: int = 1, delay: float = 0, reduce_dark: int = 1, reduce_star: int = 1, start: float | None = None) -> DataFrame:
    """Snapshots of a path shown loop times one after the other, delay milliseconds apart, as a stream of columns and frame; see ``ReplayReader``."""
    snapshots.register(spark)
    options = {"loop": loop, "delay": delay, "reduce_dark": reduce_dark, "reduce_star": reduce_star} | ({} if start is None else {"start": start})
    return spark.readStream.format(form).schema(f"{columns}, frame long").options(**options).load(path)


def _send(pdf: pd.DataFrame, until: float | None, time: str, busy: str) -> tuple[pd.DataFrame, float | None]:
    """The frames sent of one producer's, in order of time, and until when the last one is under way."""
    sent = []
    for i, t, b in pdf.sort_values(time)[[time, busy]].itertuples():
        if until is None or t >= until:
            sent.append(i)
            until = t + b
    return pdf.loc[sent], until


def sent_frames(feed: DataFrame, producer: str, time: str = "t", busy: str = "busy") -> DataFrame:
    """The frames (a row each) that a feed which never waits sends: one that comes while the producer's last one is still under way, for busy after its time, is dropped.

    On a stream the time until which a producer is busy is kept as its state."""
    kind = feed.schema
    if not feed.isStreaming:
        return feed.groupBy(producer).applyInPandas(lambda pdf: _send(pdf, None, time, busy)[0], kind)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(parts), ignore_index=True)
        rows, until = _send(whole, state.get[0] if state.exists else None, time, busy)
        if until is not None:
            state.update((float(until),))
        yield rows

    return feed.groupBy(producer).applyInPandasWithState(step, kind, "until double", "append", GroupStateTimeout.NoTimeout)


def distinct_frames(feed: DataFrame, time: str = "time", key: str = "id", delay: float | None = None, sent: str = "sent") -> DataFrame:
    """Without rows that were sent before (same time and id).

    delay: seconds after which a row cannot come again; state older than that is dropped. It needs a timestamp column sent. Without a delay, or
    on a table, all rows are remembered."""
    if delay is None or not feed.isStreaming:
        return feed.dropDuplicates([time, key])
    return feed.withWatermark(sent, f"{delay} seconds").dropDuplicatesWithinWatermark([time, key])


def each_frame(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: int = 1):
    """Run handle(frame, number) on every so many frames until the feed is used up; returns the query."""

    def one(batch: DataFrame, number: int) -> None:
        if number % every == 0 and not batch.isEmpty():
            handle(batch, number)

    query = feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class FirstFrameRange:
    """Scales a column by the range it has in the first frame, for all frames; place, a folder beside the feed's checkpoint, keeps the range over restarts."""

    def __init__(self, column: str, place: str | None = None):
        self.column, self.place, self.ends = column, place, None

    def _range(self, batch: DataFrame) -> tuple:
        spark = batch.sparkSession
        if self.place:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.place}/_SUCCESS")
            if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                return tuple(spark.read.parquet(self.place).select("lo", "hi").first())
        ends = batch.agg(F.min(self.column).alias("lo"), F.max(self.column).alias("hi"))
        found = tuple(ends.first())
        if self.place:
            spark.createDataFrame([found], ends.schema).coalesce(1).write.mode("overwrite").parquet(self.place)
        return found

    def __call__(self, batch: DataFrame) -> DataFrame:
        if self.ends is None:
            self.ends = self._range(batch)
        lo, hi = self.ends
        scaled = F.lit(0.0) if hi == lo else F.least(F.greatest((F.col(self.column) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
        return batch.withColumn(f"{self.column}_scaled", scaled)


def live_client(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, column: str = "rho", place: str | None = None, largest: float = 100.0, time: str = "time", key: str = "id"):
    """A renderer's side of a feed: rows sent before are dropped, of each frame the rows that can be drawn are handed on, with column scaled by its range in the first frame."""
    scale = FirstFrameRange(column, place)
    return each_frame(distinct_frames(feed, time, key), lambda batch, number: handle(scale(renderable(batch, largest)), number), checkpoint)


class Cadence:
    """Output times: due when the time reaches the next, which then moves on by the step but never behind the time."""

    def __init__(self, step: float, start: float = 0.0):
        self.step, self.next = step, start

    def due(self, t: float) -> bool:
        if self.step <= 0 or t < self.next:
            return False
        self.next = max(self.next + self.step, t)
        return True


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by sliding window and type; works on a stream (with its watermark) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
