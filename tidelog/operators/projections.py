"""Projections of a log: latest values, keyed state, counters, and their compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.folds import ordered_fold

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def latest(ops: DataFrame) -> DataFrame:
    """The last operation of every key. One shuffle, combined before it: keys with many operations send one row per task."""
    last = F.max_by(F.struct("op", "value", "expires_at_millis", "offset"), "offset")
    return ops.groupBy("shard", "key").agg(last.alias("l")).select("shard", "key", "l.*")


def live(state: DataFrame, now_ms: int) -> DataFrame:
    """Entries that a get finds at now: put, and without expiry or before it."""
    return state.where((F.col("op") == "put") & ((F.col("expires_at_millis") == 0) | (F.lit(now_ms) < F.col("expires_at_millis"))))


def cache_latest(ops: DataFrame, now_ms: int) -> DataFrame:
    """The live entries of a cache; version is the offset of the put."""
    return live(latest(ops), now_ms).select("shard", "key", "value", F.col("offset").alias("version"), "expires_at_millis")


def index_read(index: DataFrame, log: DataFrame) -> DataFrame:
    """The records that a key's index entry (shard, key, version) points at: a join on shard and offset, not a search of the log."""
    own = log.select("shard", F.col("offset").alias("version"), "ts_ms", "bytes")
    return index.select("shard", "key", "version").join(own, ["shard", "version"])


def watched(prefix: str | None = None, key: str | None = None) -> Column:
    """A watch's filter: one key, or a prefix ("" is all)."""
    return F.col("key") == key if key is not None else F.col("key").startswith(prefix or "")


def cache_watch(ops: DataFrame, filter_: Column, since: int, now_ms: int) -> DataFrame:
    """What a watch gets that begins with the current state: the entries retained below since, then the changes from it on."""
    own = ops.where(filter_)
    kept = cache_latest(own.where(F.col("offset") < since), now_ms)
    retained = kept.select(F.lit("retained").alias("phase"), "shard", "key", F.col("version").alias("offset"), "value")
    changes = own.where(F.col("offset") >= since).select(F.lit("change").alias("phase"), "shard", "key", "offset", "value")
    return retained.unionByName(changes)


def watch_resume(ops: DataFrame, filter_: Column, resume: DataFrame, floors: DataFrame, now_ms: int) -> DataFrame:
    """What a watch gets that resumes at an offset of each shard (resume: shard, since).

    Where compaction has passed that offset (floors: shard, floor, the offset below which changes may be gone), changes alone would miss deletes, so it is
    told to drop what it has (phase resnapshot, the floor as offset) and gets the retained entries first; else the changes from the
    offset on. Both come in order of offsets, and a marker (phase caught_up) tells the offset up to which the shard is covered.
    """
    marks = resume.join(floors, "shard", "left").withColumn("again", F.col("since") < F.coalesce("floor", F.lit(0)))
    rows = ops.where(filter_).join(F.broadcast(marks), "shard")
    state = cache_latest(rows.where("again"), now_ms)
    retained = state.select(F.lit("retained").alias("phase"), "shard", F.col("version").alias("offset"), "key", "value")
    changes = rows.where("NOT again AND offset >= since").select(F.lit("change").alias("phase"), "shard", "offset", "key", "value")
    none = (F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("value"))
    told = marks.where("again").select(F.lit("resnapshot").alias("phase"), "shard", F.col("floor").cast("long").alias("offset"), *none)
    upto = ops.groupBy("shard").agg((F.max("offset") + 1).alias("offset")).join(F.broadcast(marks.select("shard")), "shard", "left_semi")
    caught = upto.select(F.lit("caught_up").alias("phase"), "shard", "offset", *none)
    return told.unionByName(retained).unionByName(changes).unionByName(caught)


def ttl_sweep(ops: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """The deletes that a sweep writes, so that watches see entries go whose time has passed: of every shard the first `limit` by expiry, at the
    offsets after its tail. A put that replaced such an entry, or renewed it, keeps it out."""
    tails = ops.groupBy("shard").agg((F.max("offset") + 1).alias("tail"))
    due = latest(ops).where((F.col("op") == "put") & (F.col("expires_at_millis") > 0) & (F.col("expires_at_millis") <= now_ms))
    order = Window.partitionBy("shard").orderBy("expires_at_millis", "key")
    due = due.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return due.join(tails, "shard").select("shard", "key", F.lit("delete").alias("op"), F.col("offset").alias("version"), (F.col("tail") + F.col("n") - 1).alias("offset"))


def cache_cas(attempts: DataFrame) -> DataFrame:
    """Outcomes of conditional writes: expected is a version, or null for absent. An ordered fold per key.

    A write applies iff the key's live version is the expected one; its own version is its offset.
    """

    def step(state: dict, r: dict):
        held = state.get("version")
        if r["expires_held"] and held is not None and state["expires"] and r["ts_ms"] >= state["expires"]:
            held = None
        applied = held == r["expected"]
        if applied:
            state["version"] = None if r["op"] == "delete" else r["offset"]
            state["expires"] = r["expires_at_millis"]
        yield r["shard"], r["key"], r["offset"], applied, state.get("version")

    rows = attempts.withColumn("expires_held", F.lit(True))
    return ordered_fold(rows, ["shard", "key"], ["offset"], dict, step, "shard int, key string, offset long, applied boolean, version long")


def commit_state(ops: DataFrame) -> DataFrame:
    """Keyed state of a stream of atomic commits: the last operation of each key, by offset and then place in the commit. One aggregation,
    combined before it is shuffled; a commit's operations are never gathered."""
    last = ops.groupBy("shard", "key").agg(F.max(F.struct("offset", "place", "op", "value")).alias("l"))
    return last.where("l.op = 'put'").select("shard", "key", F.col("l.value").alias("value"), F.col("l.offset").alias("version"))


def commit_events(commits: DataFrame, ops: DataFrame) -> DataFrame:
    """What readers of the stream see of a commit."""
    counts = ops.groupBy("shard", "offset").agg(F.count(F.lit(1)).alias("n"))
    return commits.join(counts, ["shard", "offset"], "left").select("shard", "offset", "event", F.coalesce("n", F.lit(0)).alias("n_ops"))


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def counter_fold(ops: DataFrame) -> DataFrame:
    """Each delta's sum including it, saturating at 64 bits at every step: an ordered fold per key."""

    def step(state: dict, r: dict):
        if r["op"] == "checkpoint":
            state["sum"] = r["amount"]
        else:
            state["sum"] = min(max(state.get("sum", 0) + r["amount"], LONG_MIN), LONG_MAX)
        yield r["key"], r["offset"], r["op"], r["amount"], state["sum"]

    return ordered_fold(ops.select("key", "offset", "op", "amount"), ["key"], ["offset"], dict, step, "key string, offset long, op string, amount long, running long")


def counter_sum(ops: DataFrame) -> DataFrame:
    """Counters: deltas added after the last checkpoint, which replaces; sums saturate at 64 bits.

    One aggregation gives every key whose sums surely stay within 64 bits; the others, if there are any, are folded in order.
    """
    marks = ops.where("op = 'checkpoint'").groupBy("key").agg(F.max(F.struct("offset", "amount")).alias("m"))
    rows = ops.join(marks, "key", "left")
    after = F.when((F.col("op") == "delta") & F.coalesce(F.col("offset") > F.col("m.offset"), F.lit(True)), _wide("amount"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = rows.groupBy("key").agg(F.coalesce(F.first(_wide("m.amount"), True), zero).alias("start"), F.coalesce(F.sum(after), zero).alias("s"), F.coalesce(F.sum(F.abs(after)), zero).alias("a"))
    sums = sums.withColumn("sure", F.abs("start") + F.col("a") <= F.lit(LONG_MAX).cast("decimal(38,0)"))
    folded = counter_fold(ops.join(sums.where("NOT sure").select("key"), "key", "left_semi"))
    folded = folded.groupBy("key").agg(F.max_by("running", "offset").alias("value"))
    return sums.where("sure").select("key", (F.col("start") + F.col("s")).cast("long").alias("value")).unionByName(folded)


def counter_running(ops: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Each delta's sum including it, from the checkpoint before it; sums saturate at 64 bits.

    A key's operations are summed in blocks of offsets, so that a busy key is spread over tasks; only one row per block is
    then put in order to carry sums from block to block. Keys whose amounts could leave 64 bits are folded in order instead.
    """
    sizes = ops.groupBy("key").agg((F.sum(F.abs(_wide("amount"))) > F.lit(LONG_MAX).cast("decimal(38,0)")).alias("unsure"))
    unsure = sizes.where("unsure").select("key")
    folded = counter_fold(ops.join(unsure, "key", "left_semi")).where("op = 'delta'").drop("op")
    rows = ops.join(unsure, "key", "left_anti").withColumn("block", F.floor(F.col("offset") / block).cast("long"))
    within = Window.partitionBy("key", "block").orderBy("offset")
    rows = rows.withColumn("epoch", F.sum((F.col("op") == "checkpoint").cast("int")).over(within))
    rows = rows.withColumn("local", F.sum("amount").over(Window.partitionBy("key", "block", "epoch").orderBy("offset")))
    ends = rows.groupBy("key", "block").agg(F.max("epoch").alias("resets"), F.max_by("local", "offset").alias("end"))
    order = Window.partitionBy("key").orderBy("block")
    ends = ends.withColumn("era", F.sum((F.col("resets") > 0).cast("int")).over(order))
    ends = ends.withColumn("upto", F.sum("end").over(Window.partitionBy("key", "era").orderBy("block")))
    ends = ends.select("key", "block", F.coalesce(F.lag("upto").over(order), F.lit(0)).alias("carried"))
    out = rows.join(ends, ["key", "block"]).where("op = 'delta'")
    running = out.select("key", "offset", "amount", (F.col("local") + F.when(F.col("epoch") == 0, F.col("carried")).otherwise(0)).alias("running"))
    return running.unionByName(folded)


def compaction_survivors(ops: DataFrame, now_ms: int) -> DataFrame:
    """The operations that compaction keeps: each key's last, unless it is a delete or lapsed. Offsets stay."""
    return cache_latest(ops, now_ms)


def compaction_due(ops: DataFrame, least_bytes: int, factor: int) -> DataFrame:
    """Per shard the bytes of the log and of its live part, and whether the log is over least_bytes and factor times the live part."""
    last = ops.groupBy("shard", "key").agg(F.max_by(F.struct("op", "bytes"), "offset").alias("l"), F.sum("bytes").alias("b"))
    per = last.groupBy("shard").agg(F.sum("b").cast("long").alias("log_bytes"), F.sum(F.when(F.col("l.op") == "put", F.col("l.bytes")).otherwise(0)).cast("long").alias("live_bytes"))
    return per.withColumn("due", (F.col("log_bytes") > least_bytes) & (F.col("log_bytes") > factor * F.col("live_bytes")))


def lease_holder(ops: DataFrame, now_ms: int) -> DataFrame:
    """Who holds each lease: the first to put while it was free or lapsed, renewing at its own version. An ordered fold per lease.

    ops: lease, holder, offset, ts_ms, ttl_ms.
    """

    def step(state: dict, r: dict):
        free = not state or r["ts_ms"] >= state["until"]
        if free or state["holder"] == r["holder"]:
            state.update(holder=r["holder"], until=r["ts_ms"] + r["ttl_ms"], token=r["offset"] if free else state["token"], renewed=r["offset"])
        return ()

    def end(state: dict, key: tuple):
        yield key[0], state["holder"], state["token"], state["renewed"], state["until"] > now_ms

    return ordered_fold(ops, ["lease"], ["offset"], dict, step, "lease string, holder string, token long, version long, held boolean", end)
