"""Checks of client histories and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.folds import ordered_fold
from tidelog.functions.tables import stored

SHARD = ("stream", "shard")


AT = (*SHARD, "offset")


def set_rules(appends: DataFrame, final: DataFrame, reads: DataFrame, deliveries: DataFrame, leaders: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(rule, violations): the rules that are set operations, by rule.

    appends: value, outcome; final: stream, shard, offset, value; reads: the same, a row for each element seen; deliveries: sub, stream,
    shard, arrival, offset, value, skipped_before; leaders: stream, shard, generation, node; subscriptions: sub, stream, shard, start. What
    appends and the log hold of a value is one aggregation, what readers and subscribers saw at a place is one join.
    """
    values = appends.select("value", "outcome", F.lit(0).alias("held")).unionByName(final.select("value", F.lit(None).cast("string").alias("outcome"), F.lit(1).alias("held")))
    values = values.groupBy("value").agg(F.sum("held").alias("held"), F.count("outcome").alias("appends"), F.count(F.when(F.col("outcome") == "ok", 1)).alias("ok"), F.count(F.when(F.col("outcome") == "fail", 1)).alias("failed"))
    c = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0))
    total = lambda cond, n: F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0))
    of_values = values.agg(
        total(F.col("held") == 0, "ok").alias("acked append is missing"),
        c(F.col("held") > 1).alias("value at two offsets"),
        total(F.col("appends") == 0, "held").alias("value that nobody appended"),
        total(F.col("held") > 0, "failed").alias("failed append is present"),
    )
    seen = reads.select(*AT, "value", F.lit("read").alias("by")).unionByName(deliveries.select(*AT, "value", F.lit("delivery").alias("by")))
    both = seen.join(final.groupBy(*AT).agg(F.collect_set("value").alias("there")), list(AT), "left")
    other = F.size(F.filter("there", lambda v: v != F.col("value")))
    of_places = both.agg(
        F.coalesce(F.sum(F.when(F.col("by") == "read", F.greatest(other, F.lit(0)))), F.lit(0)).alias("read disagrees with the log"),
        c((F.col("by") == "delivery") & ~F.coalesce(F.array_contains("there", F.col("value")), F.lit(False))).alias("delivery isn't in the log"),
    )
    order = Window.partitionBy("sub").orderBy("arrival")
    of_moves = deliveries.withColumn("before", F.lag("offset").over(order)).agg(c(F.col("offset") <= F.col("before")).alias("delivery goes back"))
    # a record may be dropped as long as the offsets show it, but not be claimed absent, and not be left out at the end
    claims = deliveries.where("skipped_before > 0").select("sub", *SHARD, F.explode(F.sequence(F.col("offset") - F.col("skipped_before"), F.col("offset") - 1)).alias("offset"))
    claims = claims.join(subscriptions.select("sub", "start"), "sub").where("offset >= start").select("sub", *AT).distinct()
    hidden = claims.join(final.select(*AT).distinct(), list(AT), "left_semi").agg(F.count(F.lit(1)).alias("hidden"))
    reached = deliveries.groupBy("sub").agg((F.max("offset") + 1).alias("reached"))
    ends = final.groupBy(*SHARD).agg(F.max("offset").alias("end"))
    waits = subscriptions.join(reached, "sub", "left").join(ends, list(SHARD)).where(F.greatest(F.coalesce("reached", "start"), F.col("start")) <= F.col("end"))
    of_ends = waits.agg(F.count(F.lit(1)).alias("short"))
    writers = leaders.groupBy(*SHARD, "generation").agg(F.count_distinct("node").alias("n")).agg(c(F.col("n") > 1).alias("two writers in a generation"))
    hidden = hidden.unionByName(of_ends.select(F.col("short").alias("hidden"))).agg(F.sum("hidden").alias("record hidden or never delivered"))
    rows = [part.unpivot([], part.columns, "rule", "violations") for part in (of_values, of_places, of_moves, hidden, writers)]
    return reduce(DataFrame.unionByName, rows).select("rule", F.col("violations").cast("long").alias("violations"))


def realtime_order(ops: DataFrame) -> DataFrame:
    """Operations that began after another had ended, but stand before it in the log. One sweep per shard, no range join."""
    ends = ops.select(*SHARD, F.col("complete").alias("at"), F.lit(1).alias("kind"), F.col("offset").alias("ended"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("long").alias("offset"))
    starts = ops.select(*SHARD, F.col("invoke").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ended"), "value", "offset")
    sweep = Window.partitionBy(*SHARD).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = ends.unionByName(starts).withColumn("furthest", F.max("ended").over(sweep))
    return rows.where("kind = 0 AND furthest > offset").select(*SHARD, "value", "offset", "furthest")


def stale_gets(puts: DataFrame, gets: DataFrame) -> DataFrame:
    """Gets that saw a value although a put that began after that value's put had ended was known before the get began.

    puts: key, put, invoke, complete, acked; gets: key, get, invoke, complete, seen (a put, or null). Evidence of a put is its own
    end if it was acknowledged, and the end of every get that saw it; a get weighs the evidence strictly before it.

    A phantom, a get of a value that no put of the key wrote or whose put began after the get had ended, is a row of its own,
    with newest null (a stale get has a newest put); it is no evidence.
    """
    seen = gets.join(puts.select("key", F.col("put").alias("seen"), F.col("invoke").alias("seen_invoke"), F.col("complete").alias("seen_complete"), "acked"), ["key", "seen"], "left")
    phantom = F.col("seen").isNotNull() & (F.col("seen_invoke").isNull() | (F.col("seen_invoke") > F.col("complete")))
    phantoms = seen.where(phantom)
    seen = seen.where(~phantom)
    none = F.lit(None).cast("long")
    empty = (none.alias("get"), none.alias("seen"), none.alias("seen_complete"), F.lit(False).alias("acked"))
    evidence = puts.where("acked").select("key", F.col("complete").alias("at"), F.lit(1).alias("kind"), F.struct("invoke", "put").alias("known"), *empty)
    evidence = evidence.unionByName(seen.where("seen_invoke IS NOT NULL").select("key", F.col("complete").alias("at"), F.lit(1).alias("kind"), F.struct(F.col("seen_invoke").alias("invoke"), F.col("seen").alias("put")).alias("known"), *empty))
    asked = seen.select("key", F.col("invoke").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(evidence.schema["known"].dataType).alias("known"), "get", "seen", "seen_complete", "acked")
    sweep = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = evidence.unionByName(asked).withColumn("newest", F.max("known").over(sweep)).where("kind = 0 AND newest IS NOT NULL")
    stale = F.col("seen").isNull() | (F.col("acked") & (F.col("newest.invoke") > F.col("seen_complete")))
    found = rows.where(stale).select("key", "get", "seen", F.col("newest.put").alias("newest"))
    return found.unionByName(phantoms.select("key", "get", "seen", F.lit(None).cast(found.schema["newest"].dataType).alias("newest")))


def commit_atomicity(events: DataFrame, states: DataFrame) -> DataFrame:
    """Offsets of commits whose event or whose state is missing."""
    both = events.select("shard", "offset", F.lit(True).alias("e")).join(states.select("shard", "offset", F.lit(True).alias("s")), ["shard", "offset"], "full")
    fault = F.when(F.col("s").isNull(), "event without state").when(F.col("e").isNull(), "state without event")
    return both.select("shard", "offset", fault.alias("fault")).where("fault IS NOT NULL")


def list_cycles(appends: DataFrame, reads: DataFrame, seen: DataFrame, final: DataFrame, exact_tails: bool = True) -> DataFrame:
    """Dependency cycles of every list (stream, shard), named: one row for each strongly connected component of its operations.

    appends: stream, shard, op, value, invoke, complete, outcome; reads: stream, shard, op, invoke, complete; seen: what reads saw (op, offset,
    value); final: stream, shard, offset, value. An append depends on the one right before it (ww), a read on the last append it saw
    (wr), and the first append after what it saw on the read (rw; only with exact_tails, as else a short read proves nothing); what began after
    another operation had surely ended depends on that (rt).

    The ww edges put a list's appends in a row, so no graph is searched: every operation is entered from the appends up to some place, and
    leads to those from some place on. A way back from place `last` to place `first` closes a cycle, and makes one component of
    all between; ways that overlap make one component together. The ways back are an append that stands at two places (ww), a read whose
    next append isn't after the last it saw (rw), and an rt edge from an operation that is entered at or after the place where the other one
    leads: one sweep over time finds, for each operation, how far those that ended before it reach.

    Columns: stream, shard, first and last place of the component (places number the appends in the log), rule (G0, G1c, G-single or G2,
    with -realtime where an rt edge is part of it), ops (operations on the shortest of the component's cycles), explained (another
    rule names the same fault: a G0 where a value stands twice or real-time order is broken).
    """
    by_place = Window.partitionBy(*SHARD).orderBy("offset")
    writes = appends.where("outcome <> 'fail'").groupBy(*SHARD, "value").agg(F.min(F.struct("op", "invoke", "complete", "outcome")).alias("w")).select(*SHARD, "value", "w.*")
    owned = final.groupBy(*AT).agg(F.min("value").alias("value")).join(writes, [*SHARD, "value"])
    new = F.coalesce((F.lag("op").over(by_place) != F.col("op")).cast("int"), F.lit(1))
    owned = stored(owned.withColumn("new", new).withColumn("place", F.sum("new").over(by_place) - 1).drop("new"))

    long = lambda v: F.lit(v).cast("long")
    nodes = owned.groupBy(*SHARD, "op").agg(F.min("place").alias("leads"), F.max("place").alias("entered"), F.first("invoke").alias("invoke"), F.first("complete").alias("complete"), F.first("outcome").alias("outcome"))
    nodes = nodes.select(*SHARD, "op", "leads", "entered", "invoke", "complete", (F.col("outcome") == "ok").alias("sure"), F.lit(False).alias("read"))

    own = seen.join(reads.select(*SHARD, "op"), "op")
    last_seen = own.groupBy(*SHARD, "op").agg(F.max("offset").alias("offset"))
    last_owned = own.join(owned.groupBy(*SHARD, "value").agg(F.max("place").alias("place")), [*SHARD, "value"]).groupBy(*SHARD, "op").agg(F.max_by("place", "offset").alias("entered"))
    reading = reads.join(last_seen, [*SHARD, "op"], "left").join(last_owned, [*SHARD, "op"], "left")
    if exact_tails:
        # the next append after what was seen: from the end on, so that the frame grows and isn't computed anew for each row
        ahead = Window.partitionBy(*SHARD).orderBy(F.desc("offset"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
        line = owned.select(*SHARD, "offset", F.lit(0).alias("kind"), "place", F.lit(None).cast(reads.schema["op"].dataType).alias("op"))
        line = line.unionByName(reading.select(*SHARD, F.coalesce("offset", long(-1)).alias("offset"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("place"), "op"))
        following = line.withColumn("leads", F.min("place").over(ahead)).where("kind = 1").select("op", "leads")
        reading = reading.join(following, "op")
    else:
        reading = reading.withColumn("leads", F.lit(None).cast("long"))
    reading = reading.select(*SHARD, "op", "leads", F.coalesce("entered", long(-1)).alias("entered"), "invoke", "complete", F.lit(True).alias("sure"), F.lit(True).alias("read"))
    nodes = stored(nodes.unionByName(reading))

    sweep = Window.partitionBy(*SHARD).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begins = nodes.where("leads IS NOT NULL").select(*SHARD, F.col("invoke").alias("at"), F.lit(0).alias("kind"), "leads", "read", F.lit(None).cast("struct<entered:long,direct:boolean>").alias("from"))
    ends = nodes.where("sure").select(*SHARD, F.col("complete").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("leads"), F.lit(None).cast("boolean").alias("read"), F.struct("entered", (~F.col("read")).alias("direct")).alias("from"))
    timed = begins.unionByName(ends).withColumn("from", F.max("from").over(sweep)).where("kind = 0 AND from.entered >= leads")
    name = lambda stem, rt: F.concat(stem, F.lit("-realtime" if rt else ""))
    stem = F.when(F.col("read"), "G-single").when(~F.col("from.direct"), "G1c").otherwise("G0")
    width = F.col("from.entered") - F.col("leads") + 1
    back = timed.select(*SHARD, F.col("leads").alias("first"), F.col("from.entered").alias("last"), name(stem, True).alias("rule"), (width + F.col("read").cast("long") + (~F.col("from.direct")).cast("long")).alias("ops"))
    twice = nodes.where("entered >= leads AND (read OR entered > leads)")
    back = back.unionByName(twice.select(*SHARD, F.col("leads").alias("first"), F.col("entered").alias("last"), F.when(F.col("read"), "G-single").otherwise("G0").alias("rule"), (F.col("entered") - F.col("leads") + F.when(F.col("read"), 2).otherwise(0)).alias("ops")))

    by_first = Window.partitionBy(*SHARD).orderBy("first", F.desc("last"), "rule", "ops")
    reach = F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1))
    parts = back.withColumn("apart", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1))).withColumn("part", F.sum("apart").over(by_first))
    found = parts.groupBy(*SHARD, "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct("ops", "rule")).alias("c"))
    doubled = nodes.where("NOT read AND entered > leads").select(*SHARD).distinct().withColumn("doubled", F.lit(True))
    found = found.join(doubled, list(SHARD), "left")
    explained = (F.col("c.rule") == "G0-realtime") | ((F.col("c.rule") == "G0") & F.coalesce("doubled", F.lit(False)))
    return found.select(*SHARD, "first", "last", F.col("c.rule").alias("rule"), F.col("c.ops").alias("ops"), explained.alias("explained"))


#: The most states, and steps, of the search within one stretch of a key.
MOST_STATES, MOST_STEPS = 2_000_000, 20_000_000


def _settled(values: set, free: list, ops: list, most_states: int, most_steps: int):
    """The states after a stretch of operations, or None where the search gives up; free: unknown-outcome writes of earlier stretches.

    A state is the register's value and which of the free and the stretch's operations, a bit each, have run.
    """
    every = [(o, True) for o in free] + [(o, o["outcome"] == "info") for o in ops]
    goal = sum(1 << i for i, (_, optional) in enumerate(every) if not optional)
    ends = [float("inf") if optional else o["complete"] for o, optional in every]
    starts = [float("-inf")] * len(free) + [o["invoke"] for o in ops]
    todo, seen, out, steps = [(v, mask) for v, mask in values], set(values), set(), 0
    while todo:
        value, mask = todo.pop()
        if mask & goal == goal:
            out.add((value, mask))
        first = min((ends[i] for i in range(len(every)) if not mask >> i & 1), default=float("inf"))
        for i, (o, optional) in enumerate(every):
            if mask >> i & 1 or starts[i] > first:
                continue
            steps += 1
            for after in _after(o, optional, value):
                state = (after, mask | 1 << i)
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
        if len(seen) > most_states or steps > most_steps:
            return None
    rest = [i for i, (_, optional) in enumerate(every) if optional]
    kept = {(v, sum(1 << n for n, i in enumerate(rest) if mask >> i & 1)) for v, mask in out}
    return kept, [every[i][0] for i in rest]


def _after(o: dict, optional: bool, value):
    """The values a register may hold after an operation, none where it can't run."""
    action = o["action"]
    if action == "put":
        return (o["value"],)
    if action == "get":
        return (value,) if optional or o["value"] == value else ()
    if action == "delete":  # with `expect`: that is what it reported to have removed
        return (None,) if o.get("expect") is None or o["expect"] == value else ()
    applied = o.get("applied")  # put_if
    if applied is None or applied:
        return (o["value"],) if o["expect"] == value else ()
    return (value,) if o["expect"] != value else ()


def linearizable(ops: DataFrame, most_states: int = MOST_STATES, most_steps: int = MOST_STEPS) -> DataFrame:
    """A verdict per key for puts, gets, deletes and conditional puts of a register that starts absent: yes, no, or unknown.

    ops: key, invoke, complete, action (put, get, delete, put_if), value, outcome (info: may or may not have happened, at any time after its
    start), and, where such are among them, expect (of a put_if, null for absent; of a delete what it removed) and applied (of a put_if).
    Puts of unknown outcome whose value nobody saw are left out first: any order that has one can do without it, unless the key has
    conditional puts. An ordered fold: between two moments without an open operation only the possible values are kept. Where a stretch is over
    the budget, any value written so far may follow: later stretches are still judged, and "unknown" is the verdict only if none fails.
    """
    names = ops.columns
    sights = ops.where("action = 'get' OR action = 'delete'").select("key", (F.when(F.col("action") == "get", F.col("value")).otherwise(F.col("expect") if "expect" in names else F.lit(None))).alias("value"))
    sights = sights.where("value IS NOT NULL").distinct().withColumn("seen", F.lit(True))
    rows = ops.join(sights, ["key", "value"], "left")
    if "applied" in names:
        rows = rows.join(ops.where("action = 'put_if'").select("key").distinct().withColumn("conditional", F.lit(True)), "key", "left")
        rows = rows.withColumn("seen", F.coalesce("seen", "conditional")).drop("conditional")
    rows = rows.where("outcome <> 'fail' AND NOT (action = 'put' AND outcome = 'info' AND seen IS NULL)").select(*names)

    def settle(state: dict) -> None:
        stretch, state["open"] = state["open"], []
        if state["verdict"] == "no" or not stretch:
            return
        state["written"].update(o["value"] for o in stretch if o["action"] in ("put", "put_if"))
        got = _settled(state["values"], state["free"], stretch, most_states, most_steps)
        if got is None:
            state["verdict"] = "unknown"
            state["free"] = state["free"] + [o for o in stretch if o["outcome"] == "info"]
            state["values"] = {(v, 0) for v in state["written"] | {None}}
            return
        state["values"], state["free"] = got
        if not state["values"]:
            state["verdict"] = "no"

    def step(state: dict, r: dict):
        if state["open"] and r["invoke"] > state["until"]:
            settle(state)
        if not state["open"]:
            state["until"] = r["invoke"]
        state["open"].append(r)
        if r["outcome"] != "info":
            state["until"] = max(state["until"], r["complete"])
        state["n"] += 1
        return ()

    def end(state: dict, key: tuple):
        settle(state)
        yield key[0], state["n"], state["verdict"]

    make = lambda: {"open": [], "until": 0, "values": {(None, 0)}, "free": [], "written": set(), "verdict": "yes", "n": 0}
    return ordered_fold(rows, ["key"], ["invoke", "complete"], make, step, "key string, ops long, verdict string", end)


def ledger_verdict(writes: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: what became of acked, refused and in-doubt writes (key, outcome) among the keys seen on reading again (key, repeats)."""
    per = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = writes.join(per, "key", "full")
    c = lambda cond: F.count(F.when(cond, 1))
    there = F.col("n").isNotNull()
    return both.agg(
        c((F.col("outcome") == "acked") & ~there).alias("gaps"),
        F.coalesce(F.sum(F.when(there, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        c((F.col("outcome") == "acked") & (F.col("n") == 1)).alias("acked_once"),
        c((F.col("outcome") == "refused") & there).alias("refused_present"),
        c((F.col("outcome") == "in_doubt") & there).alias("in_doubt_landed"),
        c((F.col("outcome") == "in_doubt") & ~there).alias("in_doubt_absent"),
        c(F.col("outcome").isNull()).alias("unexpected"),
    )


def divergence(authority: DataFrame, replica: DataFrame) -> DataFrame:
    """Keys whose replica differs from the authority; a key that the authority never had isn't wrong."""
    both = authority.where("value IS NOT NULL").join(replica.withColumnRenamed("value", "local"), "key", "left")
    return both.where(~F.col("value").eqNullSafe(F.col("local"))).select("key", "value", "local")


def drain_time(ops: DataFrame, at_us: int) -> DataFrame:
    """Per shard what was outstanding at a moment (begun, not acknowledged), and how long it took from there until none of it was."""
    out = ops.where((F.col("begin") <= at_us) & (F.col("acked_at") > at_us))
    return out.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("outstanding"), (F.max("acked_at") - at_us).alias("drain_us"))


def stalls(ops: DataFrame, least_us: int) -> DataFrame:
    """Stretches in which the oldest outstanding operation had waited least_us or more, per shard: operations that wait so long, merged where they overlap."""
    order = Window.partitionBy(*SHARD).orderBy("begin", "acked_at")
    long_ = ops.where(F.col("acked_at") - F.col("begin") >= least_us)
    until = F.max("acked_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = long_.withColumn("new", (F.coalesce(until, F.lit(-1)) < F.col("begin") + least_us).cast("int"))
    rows = rows.withColumn("stall", F.sum("new").over(order))
    t = rows.groupBy(*SHARD, "stall").agg((F.min("begin") + least_us).alias("from_us"), F.max("acked_at").alias("until_us"), F.count(F.lit(1)).alias("waiting"))
    return t.drop("stall")
