"""Reads of a log: pages, positions, times, gaps, segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.folds import ordered_fold

SCOPE = ("stream", "shard")
PAGE_BYTES = 4 << 20


class CursorTooOld(ValueError):
    """A read from below the log's base."""


class CursorInFuture(ValueError):
    """A read from past the log's tail."""


class NotDurable(ValueError):
    """A read from an offset of a stream that keeps no log."""


def check_range(log: DataFrame, start: int, durable: bool = True) -> None:
    """Raises where a read of one shard from start can't be answered."""
    if not durable:
        raise NotDurable("the stream isn't durable")
    base, tail = log.agg(F.min("offset"), F.max("offset") + 1).first()
    if base is None:
        if start > 0:
            raise CursorInFuture(f"{start} is past the tail 0")
    elif start < base:
        raise CursorTooOld(f"{start} is below the base {base}")
    elif start > tail:
        raise CursorInFuture(f"{start} is past the tail {tail}")


def range_page(log: DataFrame, start: int, stop: int, max_records: int, max_bytes: int = PAGE_BYTES) -> DataFrame:
    """Of each shard the records in [start, stop) within both bounds, one at least, with next_offset of the page."""
    rows = log.where((F.col("offset") >= start) & (F.col("offset") < stop))
    order = Window.partitionBy(*SCOPE).orderBy("offset")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_records)
    rows = rows.withColumn("_b", F.sum(F.octet_length("payload")).over(order)).where((F.col("_n") == 1) | (F.col("_b") <= max_bytes))
    return rows.withColumn("next_offset", F.max("offset").over(Window.partitionBy(*SCOPE)) + 1).drop("_n", "_b")


def start_positions(log: DataFrame, requested: int) -> DataFrame:
    """Where a subscription starts: earliest, latest, or a requested offset kept within both."""
    t = log.groupBy(*SCOPE).agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"))
    return t.withColumn("requested", F.least(F.greatest(F.lit(requested).cast("long"), "earliest"), "latest"))


def offset_for_time(log: DataFrame, times: list[int], bound: Column | None = None) -> DataFrame:
    """For each shard and time (microseconds) the first offset with ts_us >= time, below bound if one is given; null if none.

    One aggregation answers all times, whose list is short; the log isn't joined.
    """
    seen = log if bound is None else log.where(F.col("offset") < bound)
    firsts = seen.groupBy(*SCOPE).agg(*(F.min(F.when(F.col("ts_us") >= t, F.col("offset"))).alias(f"t{i}") for i, t in enumerate(times)))
    answers = F.array(*(F.struct(F.lit(t).cast("long").alias("time_us"), F.col(f"t{i}").alias("offset")) for i, t in enumerate(times)))
    return firsts.select(*SCOPE, F.explode(answers).alias("a")).select(*SCOPE, "a.*")


def list_offsets(log: DataFrame) -> DataFrame:
    """Earliest and latest offset, and the last data record (not the one with the greatest time) with its time in ms."""
    data = F.col("mark_kind") == "data"
    last = F.max(F.when(data, F.struct("offset", F.floor(F.col("ts_us") / 1000).cast("long").alias("ms"))))
    t = log.groupBy(*SCOPE).agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("latest"), last.alias("m"))
    return t.select(*SCOPE, "earliest", "latest", F.col("m.offset").alias("max_timestamp_offset"), F.col("m.ms").alias("max_timestamp_ms"))


def data_records(log: DataFrame) -> DataFrame:
    """Data records with the number of control records skipped before each."""
    order = Window.partitionBy(*SCOPE).orderBy("offset")
    rows = log.where("mark_kind = 'data'")
    return rows.withColumn("skipped_before", F.col("offset") - F.coalesce(F.lag("offset").over(order), F.lit(-1)) - 1)


def trailing_gap(log: DataFrame) -> DataFrame:
    """The run of control records at the end of each shard (first, last): a reader of data records is moved past them."""
    last = log.groupBy(*SCOPE).agg(F.max("offset").alias("last"), F.max(F.when(F.col("mark_kind") == "data", F.col("offset"))).alias("data"), F.min("offset").alias("base"))
    return last.withColumn("first", F.coalesce(F.col("data") + 1, "base")).where(F.col("first") <= F.col("last")).select(*SCOPE, "first", "last")


def merged(shards: list[DataFrame]) -> DataFrame:
    """The shards of a stream as one. Shards share no record, so nothing has to be dropped."""
    return reduce(DataFrame.unionByName, shards)


def resume_vector(log: DataFrame) -> DataFrame:
    return log.groupBy(*SCOPE).agg((F.max("offset") + 1).alias("resume"), F.count(F.lit(1)).alias("records"))


#: The most records on either side of an offset, and the most where payloads come along.
AROUND, AROUND_WITH_PAYLOAD = 1000, 100


def records_around(log: DataFrame, offset: int, n: int, payload_bytes: int = 65536) -> DataFrame:
    """The record at an offset (or the first one after it) and up to n records on either side, payloads cut; 0 payload bytes leave them out."""
    n = min(n, AROUND_WITH_PAYLOAD if payload_bytes else AROUND)
    behind = F.col("offset") < offset
    ahead, back = Window.partitionBy(*SCOPE, "_behind").orderBy("offset"), Window.partitionBy(*SCOPE, "_behind").orderBy(F.desc("offset"))
    rows = log.withColumn("_behind", behind).withColumn("_n", F.when(F.col("_behind"), F.row_number().over(back)).otherwise(F.row_number().over(ahead) - 1))
    near = rows.where(F.col("_n") <= n).drop("_n", "_behind")
    return near.withColumn("payload", F.substring("payload", 1, payload_bytes)) if payload_bytes else near.drop("payload")


def gap_report(turns: DataFrame) -> DataFrame:
    """Gaps in what each subscriber got, and how much of them is loss: control records aren't."""
    order = Window.partitionBy("sub").orderBy("offset")
    controls = F.sum(F.col("control").cast("long")).over(order)
    got = turns.withColumn("controls", controls).where(~F.col("gone"))
    before = F.coalesce(F.lag("offset").over(order), F.lit(-1))
    skipped = F.col("controls") - F.coalesce(F.lag("controls").over(order), F.lit(0))
    rows = got.select("sub", "offset", (F.col("offset") - before - 1).alias("gap"), skipped.alias("skipped"))
    return rows.where("gap > 0").withColumn("lost", F.col("gap") - F.col("skipped"))


def segment_report(log: DataFrame, size: int = 64) -> DataFrame:
    segment = F.floor(F.col("offset") / size).cast("long")
    return log.groupBy(*SCOPE, segment.alias("segment")).agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.max("ts_us").alias("newest_us"))


#: Segments that share a file where a log is offloaded.
FILE_SEGMENTS = 1 << 12


def offload(log: DataFrame, path: str, size: int = 64, together: int = FILE_SEGMENTS) -> DataFrame:
    """A log's sealed segments (all but each shard's last one) written to a folder by stream, shard and run of `together` segments, and read from there.
    A run is a file in order of offsets, so that a read of one segment finds it by the run's name and the file's statistics; small segments
    don't make as many files."""
    rows = log.withColumn("segment", F.floor(F.col("offset") / size).cast("long")).withColumn("run", F.floor(F.col("segment") / together).cast("long"))
    active = log.groupBy(*SCOPE).agg(F.floor(F.max("offset") / size).cast("long").alias("_active"))
    sealed = rows.join(active, list(SCOPE)).where(F.col("segment") < F.col("_active")).drop("_active")
    sealed.repartition(*SCOPE, "run").sortWithinPartitions(*SCOPE, "run", "offset").write.mode("overwrite").partitionBy(*SCOPE, "run").parquet(path)
    return log.sparkSession.read.schema(sealed.schema).parquet(path).drop("run")


def publish_report(records: DataFrame, refused: Column) -> DataFrame:
    """What becomes of batches whose records (batch, position, key, shard, bytes) belong to several shards: a piece for each shard, in the batch's own
    order, that is taken or refused as a whole. refused: by batch and shard. failed: the positions to send again."""
    pieces = records.groupBy("batch", "shard").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").cast("long").alias("bytes"), F.array_sort(F.collect_list("position")).alias("positions"))
    return pieces.withColumn("ok", ~refused).withColumn("failed", F.when(refused, F.array_join("positions", ","))).drop("positions")


def assign_offsets(arrivals: DataFrame, tails: DataFrame, by: list[str]) -> DataFrame:
    """Arrivals with the offsets an append gives them: contiguous from each shard's tail, in order of arrival."""
    order = Window.partitionBy(*SCOPE).orderBy(*by)
    rows = arrivals.withColumn("_n", F.row_number().over(order) - 1).join(tails.select(*SCOPE, "tail"), list(SCOPE), "left")
    return rows.withColumn("offset", (F.coalesce("tail", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "tail")


def committed_visible(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Records below their shard's committed mark (kinds: unbounded, committed, settling, refused; the last two show nothing)."""
    seen = (F.col("kind") == "unbounded") | ((F.col("kind") == "committed") & (F.col("offset") < F.col("mark")))
    return log.join(marks, list(SCOPE)).where(seen).drop("kind", "mark")


def conditional_batches(pieces: DataFrame) -> DataFrame:
    """Pieces (batch, position, len) of batches that are whole, below the first piece of an undecided batch at the tail."""
    per = pieces.groupBy(*SCOPE, "batch").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"), F.min("offset").alias("first"), F.max("offset").alias("last"))
    tail = per.groupBy(*SCOPE).agg(F.max_by(F.struct("n", "len", "first"), "last").alias("t"))
    bound = tail.select(*SCOPE, F.when(F.col("t.n") < F.col("t.len"), F.col("t.first")).alias("bound"))
    whole = per.where("n = len").join(bound, list(SCOPE)).where("bound IS NULL OR last < bound")
    return pieces.join(whole.select(*SCOPE, "batch"), [*SCOPE, "batch"], "left_semi")


def epoch_ranges(log: DataFrame, generation: Column) -> DataFrame:
    """Generation, where it starts, and where the next one starts."""
    starts = log.groupBy(*SCOPE, generation.alias("generation")).agg(F.min("offset").alias("start_offset"))
    order = Window.partitionBy(*SCOPE).orderBy("start_offset")
    return starts.withColumn("end_offset", F.lead("start_offset").over(order))


def retention_prefix(segments: DataFrame, max_bytes: int, max_age_us: int, now_us: int) -> DataFrame:
    """Segments that retention deletes: from the oldest on while the log is over max_bytes or the segment's newest record is too old; never the active one."""
    shard = Window.partitionBy(*SCOPE)
    order = shard.orderBy("segment")
    total = F.sum("bytes").over(shard)
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goes = ((total - before) > max_bytes) | (F.lit(now_us) - F.col("newest_us") > max_age_us)
    rows = segments.withColumn("_goes", goes & (F.col("segment") < F.max("segment").over(shard)))
    return rows.withColumn("_all", F.min(F.col("_goes").cast("int")).over(order)).where("_all = 1").drop("_goes", "_all")


def ring_tail(log: DataFrame, max_bytes: int) -> DataFrame:
    """The newest records within max_bytes; the newest is kept even if it is larger."""
    order = Window.partitionBy(*SCOPE).orderBy(F.desc("offset"))
    rows = log.withColumn("_b", F.sum(F.octet_length("payload")).over(order)).withColumn("_n", F.row_number().over(order))
    return rows.where((F.col("_b") <= max_bytes) | (F.col("_n") == 1)).drop("_b", "_n")


def trim_floor(log: DataFrame, trims: DataFrame) -> DataFrame:
    """Records at or above the highest floor that a trim set for their shard."""
    floors = trims.groupBy(*SCOPE).agg(F.max("floor").alias("_floor"))
    return log.join(floors, list(SCOPE), "left").where("offset >= coalesce(_floor, 0)").drop("_floor")


def trim_fold(trims: DataFrame) -> DataFrame:
    """Outcomes of trims (stream, shard, seq, before, expected): one that names the floor it expects applies only if that is the floor, and the floor
    never falls. An ordered fold per shard; the answer carries the floor."""

    def step(state: dict, r: dict):
        floor = state.get("floor", 0)
        applied = r["expected"] is None or r["expected"] == floor
        if applied:
            state["floor"] = max(floor, r["before"])
        yield r["stream"], r["shard"], r["seq"], applied, state.get("floor", 0)

    return ordered_fold(trims, list(SCOPE), ["seq"], dict, step, "stream string, shard int, seq long, applied boolean, floor long")


def apply_in_order(arrivals: DataFrame) -> DataFrame:
    """When each of the commits that finish in any order (stream, shard, offset, finished) is applied: with or after all before it."""
    order = Window.partitionBy(*SCOPE).orderBy("offset")
    return arrivals.withColumn("applied", F.max("finished").over(order))


def lag_notices(consumed: DataFrame, tails: DataFrame, room: int) -> DataFrame:
    """Subscriptions (sub, stream, shard, position) that fell behind their queue of `room` records: how many records were dropped, and where to resume
    so that none is missed."""
    rows = consumed.join(tails.select(*SCOPE, "tail"), list(SCOPE)).withColumn("dropped", F.col("tail") - F.col("position") - room)
    return rows.where("dropped > 0").select("sub", *SCOPE, "dropped", F.col("position").alias("resume"))
