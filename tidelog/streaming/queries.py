"""Live reads as Structured Streaming: file source, checkpoints in the shared folder, available-now runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.tables import shared_path, stored
from tidelog.operators import projections, queues


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files; ts is an instant, as watermarks need."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def resumed(stream: DataFrame, out: str, marks: str) -> DataFrame:
    """What a subscription has got up to now: the stream is read on from where its checkpoint (marks) stands, written exactly once to out, and
    read from there. A subscription that was stopped, or lost, goes on without a gap or a repeat."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a new subscription has got up to now."""
    return resumed(stream, shared_path(stream.sparkSession, name), shared_path(stream.sparkSession, f"{name}-state"))


#: Rows that arrive at a time, and answers that are handed on at a time.
SLICE, ANSWERS = 1 << 22, 10_000


def arriving(rows: DataFrame, at: str, follow: Callable[[DataFrame], DataFrame], name: str, most: int = SLICE) -> DataFrame:
    """What follow(stream) has given once all rows have come, in order of `at`, some `most` of them at a time: a micro-batch holds one slice of time,
    so that what follow keeps of a micro-batch doesn't grow with the table. Rows of one time come together."""
    table, spark = stored(rows, f"{name}-rows"), rows.sparkSession
    came, out, marks = (shared_path(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    slices = max(1, -(-table.count() // most))
    found = table.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] if slices > 1 else []
    ends = sorted(set(found))
    for low, high in zip([None, *ends], [*ends, None]):
        part = table if low is None else table.where(F.col(at) > low)
        (part if high is None else part.where(F.col(at) <= high)).write.mode("append").parquet(came)
        got = resumed(follow(spark.readStream.schema(table.schema).parquet(came)), out, marks)
    return got


def tail(spark: SparkSession, d: str, stream: str) -> DataFrame:
    """A live subscription to one stream."""
    rows = events(spark, d).where(F.col("event_type") == stream).select("event_id", "user_id", F.unix_micros("ts").alias("ts_us"), "props")
    return drained(rows, "tail")


def replay_then_live(spark: SparkSession, d: str, history: DataFrame, overlap: Column) -> DataFrame:
    """History, then the live stream that overlaps it: every record once, by its id."""
    live = drained(events(spark, d).where(overlap).select("event_id", "user_id", "props"), "live")
    return history.select("event_id", "user_id", "props").unionByName(live).dropDuplicates(["event_id"])


def dedupe(spark: SparkSession, d: str, within: str) -> DataFrame:
    """Producers' re-sends (an event comes twice) dropped within a watermark."""
    rows = events(spark, d)
    twice = rows.withColumn("copy", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    once = twice.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "event_id"])
    return drained(once.select("user_id", "event_id", "props"), "dedupe")


def windows(rows: DataFrame, window: Column, keys: list[str]) -> DataFrame:
    """Counts and sums of cents per window and key; rows: ts (an instant), cents."""
    t = rows.withWatermark("ts", "1 hour").groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return t.select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *keys, "n", "cents")


def cache_watch(ops: DataFrame, filter_: Column, since: int, now_ms: int) -> DataFrame:
    """A live watch over a cache's stored log, from an offset on: the state below it as a batch, then the changes as a stream, until the stream has
    caught up with what there is. A row is in one of them only, by its offset."""
    spark, path = ops.sparkSession, shared_path(ops.sparkSession, "cache-log")
    ops.write.partitionBy("shard").parquet(path)
    table = spark.read.schema(ops.schema).parquet(path)
    kept = projections.cache_latest(table.where(filter_ & (F.col("offset") < since)), now_ms)
    retained = kept.select(F.lit("retained").alias("phase"), "shard", "key", F.col("version").alias("offset"), "value")
    live = spark.readStream.schema(ops.schema).parquet(path).where(filter_ & (F.col("offset") >= since))
    return retained.unionByName(drained(live.select(F.lit("change").alias("phase"), "shard", "key", "offset", "value"), "watch"))


CLAIM_ROWS = "stream string, shard int, at_ms long, seq long, event string, offset long, result string, attempts int"


def claims(events: DataFrame, visibility_ms: int, bound: int = 5) -> DataFrame:
    """What becomes of polls and answers, as queues.queue_claims tells it, for a stream of events with a watermark on `at`: the group's queue on
    a shard is the state of its key. A timer at the first deadline tells of claims that lapsed (event timer, result lapsed) without waiting for a poll.
    Events of a micro-batch are put in order; a micro-batch must not hold events before those of an earlier one."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [c.split()[0] for c in CLAIM_ROWS.split(", ")]
    told = ["at_ms", "seq", "event", "offset", "size", "consumer", "most", "delay_ms"]

    def run(key, batches, state):
        import pickle

        queue = queues.Deliveries(visibility_ms, bound)
        if state.exists:
            queue.__setstate__(pickle.loads(state.get[0]))
        out = []
        flush = lambda: pd.DataFrame(out, columns=names).astype({"attempts": "Int32"})
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            for offset, c in sorted(queue.claims.items()):
                if now >= c["until"] and not c.get("told"):
                    c["told"] = True
                    out.append((*key, now, -1, "timer", offset, "lapsed", c["attempts"]))
        else:
            rows = pd.concat([b[told] for b in batches]).sort_values(["at_ms", "seq"])
            for low in range(0, len(rows), ANSWERS):
                some = rows.iloc[low : low + ANSWERS]
                for values in zip(*(some[c].tolist() for c in told)):
                    out += queues.happen(queue, {"stream": key[0], "shard": key[1], **dict(zip(told, values))})
                if len(out) >= ANSWERS:
                    yield flush()
                    out = []
        state.update((pickle.dumps(queue.__getstate__()),))
        deadlines = [c["until"] for c in queue.claims.values() if not c.get("told")]
        if deadlines:
            state.setTimeoutTimestamp(max(min(deadlines), state.getCurrentWatermarkMs() + 1))
        yield flush()

    rows = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "0 seconds")
    return rows.groupBy("stream", "shard").applyInPandasWithState(run, CLAIM_ROWS, "queue binary", "append", GroupStateTimeout.EventTimeTimeout)
