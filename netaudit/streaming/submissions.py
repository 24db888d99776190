"""Submissions as a stream: identical ones are audited once within a time to live, new packages as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netaudit.operators.cut import cut

HOUR_MS = 3_600_000


def content_hash(content: list[str], *more: Column) -> Column:
    """A hash of the named columns and whatever else makes a submission a different one, as parameters and the version of the rules."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in (*map(F.col, content), *more)]), 256)


def _first_within(at: str, ttl_ms: int):
    """Lets the earliest row of a key pass, unless one has passed within the time to live. The state is the time when that is over."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for frame in frames:
            early = frame.sort_values(at, kind="stable").head(1)
            first = early if first is None or early[at].iloc[0] < first[at].iloc[0] else first
        now = state.getCurrentProcessingTimeMs()
        ends = state.get[0] if state.exists else now
        if ends <= now and first is not None:
            ends = now + ttl_ms
            state.update((ends,))
            yield first
        state.setTimeoutDuration(max(1, ends - now))

    return run


def dedupe_for(stream: DataFrame, at: str, content: list[str], ttl_ms: int = HOUR_MS, *more: Column) -> DataFrame:
    """Rows with content_hash of which none with that hash has passed within ttl_ms of processing time; of several in a batch, the earliest. State is one time a
    hash and goes when that is over, so it holds what came within the time to live and no more, and outlives a restart."""
    keyed = stream.withColumn("content_hash", content_hash(content, *more))
    return keyed.groupBy("content_hash").applyInPandasWithState(_first_within(at, ttl_ms), keyed.schema, "ends long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def dedupe_submissions(stream: DataFrame, at: str, content: list[str], ttl: str = "1 hour") -> DataFrame:
    """As dedupe_for by the rows' own time: state is dropped as the watermark passes."""
    return stream.withColumn("content_hash", content_hash(content)).withWatermark(at, ttl).dropDuplicatesWithinWatermark(["content_hash"])


def _passing(ttl: int):
    """Of rows in the order of content and time (_at, microseconds), those that pass, batch by batch; the content and the time that passed last are all that is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, ends = None, None
        for batch in batches:
            keep = []
            for h, at in zip(batch["content_hash"].to_pylist(), batch["_at"].to_pylist(), strict=True):
                passes = h != content or (at is not None and ends is not None and at >= ends)
                if passes:
                    content, ends = h, None if at is None else at + ttl
                keep.append(passes)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["content_hash", "_row"])

    return run


def dedupe_batch(rows: DataFrame, order: str, content: list[str], hours: float | None = None, most: int = 100_000) -> DataFrame:
    """The first row, in an order, of each content of a whole table. With hours, `order` is a time: a row passes if none of its content passed less than so
    long before; of equal times the first by the other columns. Contents are sorted and read once; those of more than `most` rows, which no task should hold, take rounds over
    what is left of them, of which each takes the first row of every content."""
    keyed = rows.select(content_hash(content).alias("content_hash"), F.struct(*rows.columns).alias("_row"))
    first = lambda df: df.groupBy("content_hash").agg(F.min_by("_row", f"_row.{order}").alias("_row"))
    if hours is None:
        return first(keyed).select("content_hash", "_row.*")
    time, rest = F.col(f"_row.{order}"), [F.col(f"_row.{c}") for c, t in rows.dtypes if c != order and not t.startswith(("map", "variant"))]
    at = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', _row.`{order}`)") if dict(rows.dtypes)[order] == "timestamp_ntz" else F.unix_micros(time)
    crowded = cut(keyed.groupBy("content_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("content_hash"))
    sorted_ = keyed.join(crowded, "content_hash", "left_anti").withColumn("_at", at).repartition("content_hash").sortWithinPartitions("content_hash", F.asc_nulls_last("_at"), *rest)
    kept = sorted_.mapInArrow(_passing(round(hours * 3.6e9)), keyed.schema)
    if crowded.isEmpty():
        return kept.select("content_hash", "_row.*")
    keyed = keyed.join(crowded, "content_hash", "left_semi")
    first = lambda df: df.groupBy("content_hash").agg(F.min_by("_row", F.struct(time, *rest)).alias("_row"))
    while True:
        now = cut(first(keyed))
        kept = kept.unionByName(now)
        since = now.select("content_hash", F.col(f"_row.{order}").alias("_since"))
        keyed = cut(keyed.join(since, "content_hash").where(F.col(f"_row.{order}") >= F.col("_since") + F.make_dt_interval(secs=F.lit(hours * 3600.0))).drop("_since"))
        if keyed.isEmpty():
            return kept.select("content_hash", "_row.*")


def audit_stream(stream: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the batch audit over each batch of new features and writes its issues below path, a folder for each batch. A batch that is run
    again after a failure overwrites its own folder, so each is there once. The trigger is availableNow unless another is given; a stream of
    dedupe_for has times that run out, for which Spark goes on making batches, so it wants processingTime, or once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
