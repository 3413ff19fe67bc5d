"""Consumer groups, idempotent producers, quorums and placement."""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.folds import ordered_fold
from tidelog.functions.hashing import batch_digest, node_hashes, rendezvous_scores, shard_hashes

SHARD = ("stream", "shard")
WINDOW = 64
WRAP = 1 << 31


def group_fold(ops: DataFrame) -> DataFrame:
    """State of every consumer group after its shard's entries, in index order: an ordered fold per shard.

    ops: shard, idx, grp, op, to, target, cre (index of the creation the writer saw), attempts, holder. Entries at or below the
    last index applied are ignored; writes decided for an incarnation that is gone are dropped.
    """

    def fresh(cre: int, cursor: int) -> dict:
        return {"cre": cre, "cursor": cursor, "dead": set(), "redriven": set(), "claims": {}}

    def step(state: dict, r: dict):
        if r["idx"] <= state["applied"]:
            return ()
        state["applied"] = r["idx"]
        groups, name, op = state["groups"], r["grp"], r["op"]
        g = groups.get(name)
        if op == "seek":
            if g is None:
                groups[name] = fresh(r["idx"], r["to"])
            else:
                g.update(cre=r["idx"], cursor=r["to"], dead={x for x in g["dead"] if x < r["to"]}, claims={})
            return ()
        if op == "delete":
            groups.pop(name, None)
            state["deleted"] = r["idx"]
            return ()
        if (g is not None and g["cre"] != r["cre"]) or (g is None and r["cre"] < state["deleted"]):
            return ()
        at = r["target"]
        if op == "advance":
            g = groups.setdefault(name, fresh(r["cre"], r["to"]))
            g["cursor"] = max(g["cursor"], r["to"])
            g["claims"] = {o: a for o, a in g["claims"].items() if o >= g["cursor"] or o in g["redriven"]}
        elif op == "dead_letter":
            g = groups.setdefault(name, fresh(r["cre"], 0))
            g["dead"].add(at)
            g["redriven"].discard(at)
            g["claims"].pop(at, None)
        elif g is None:
            return ()
        elif op == "redrive" and at in g["dead"]:
            g["dead"].discard(at)
            g["redriven"].add(at)
        elif op == "finish_redrive":
            g["redriven"].discard(at)
            if at < g["cursor"]:
                g["claims"].pop(at, None)
        elif op == "discard":
            g["dead"].discard(at)
        elif op == "claim" and (at >= g["cursor"] or at in g["redriven"]):
            g["claims"][at] = r["attempts"]
        return ()

    def end(state: dict, key: tuple):
        for name, g in sorted(state["groups"].items()):
            yield key[0], name, g["cursor"], sorted(g["dead"]), sorted(g["redriven"]), sorted(g["claims"])

    make = lambda: {"applied": -1, "deleted": -1, "groups": {}}
    return ordered_fold(ops, ["shard"], ["idx"], make, step, "shard int, grp string, cursor long, dead array<long>, redriven array<long>, claims array<long>", end)


def cursor_max(ops: DataFrame) -> DataFrame:
    """A group's committed cursor: the furthest advance since its last seek, or where that seek went."""
    seeks = ops.where("op = 'seek'").groupBy("shard", "grp").agg(F.max(F.struct("idx", "to")).alias("s"))
    rows = ops.where("op = 'advance'").join(seeks, ["shard", "grp"], "left").where("s IS NULL OR idx > s.idx")
    far = rows.groupBy("shard", "grp").agg(F.max("to").alias("far"))
    return far.join(seeks, ["shard", "grp"], "full").select("shard", "grp", F.greatest("far", "s.to").alias("cursor"))


def cursor_contiguous(acks: DataFrame, start: int = 0) -> DataFrame:
    """Per shard the first offset from start on that isn't acknowledged: where the cursor may stand."""
    rows = acks.where(F.col("offset") >= start)
    return rows.groupBy(*SHARD).agg(F.coalesce(F.min(F.when(~F.col("acked"), F.col("offset"))), F.max("offset") + 1).alias("cursor"), F.count(F.when(F.col("acked"), 1)).alias("acked"))


def group_describe(acks: DataFrame, bound: int = 5) -> DataFrame:
    """Committed, tail, lag, in flight, owed and dead letters of the group on every shard; a record over the bound of attempts is dead."""
    dead = ~F.col("acked") & (F.col("attempts") > bound)
    first = F.min(F.when(~F.col("acked") & ~dead, F.col("offset")))
    t = acks.groupBy(*SHARD).agg(
        (F.max("offset") + 1).alias("tail"),
        F.coalesce(first, F.max("offset") + 1).alias("committed"),
        F.count(F.when(~F.col("acked") & ~dead & (F.col("attempts") > 1), 1)).alias("owed"),
        F.count(F.when(~F.col("acked") & ~dead & (F.col("attempts") <= 1), 1)).alias("in_flight"),
        F.count(F.when(dead, 1)).alias("dead_letters"),
    )
    return t.withColumn("lag", F.col("tail") - F.coalesce("committed", F.lit(0)))


def idempotent_dedupe(sends: DataFrame) -> DataFrame:
    """A verdict for each send, where producers leave no gap: the first of a sequence appends; a repeat is expired if the window has moved
    past it, reused if its payload isn't the first one's, else a duplicate."""
    of_seq = Window.partitionBy("shard", "producer_id", "sequence").orderBy("arrival")
    so_far = Window.partitionBy("shard", "producer_id").orderBy("arrival")
    rows = sends.withColumn("n", F.row_number().over(of_seq)).withColumn("same", F.first("payload").over(of_seq).eqNullSafe(F.col("payload")))
    rows = rows.withColumn("following", F.max("sequence").over(so_far) + 1)
    verdict = F.when(F.col("n") == 1, "append").when(F.col("sequence") < F.col("following") - WINDOW, "expired").when(~F.col("same"), "reused").otherwise("duplicate")
    return rows.select("shard", "producer_id", "sequence", "arrival", verdict.alias("verdict"))


def idempotent_fold(sends: DataFrame, wrap: int | None = None) -> DataFrame:
    """The exact verdict for each send, gaps included; sequences wrap at `wrap`. An ordered fold per producer of a shard.

    The digests of the last WINDOW batches are remembered; a send is a batch of one payload.
    """

    def step(state: dict, r: dict):
        following, seq = state.get("next"), r["sequence"]
        recent = state.setdefault("recent", {})
        if following is None:
            verdict = "append" if seq == 0 else "unknown"
        else:
            ahead = (seq - following) % wrap if wrap else seq - following
            if wrap and ahead >= wrap // 2:
                ahead -= wrap
            verdict = "append" if ahead == 0 else "gap" if ahead > 0 else "expired" if seq not in recent else "duplicate" if recent[seq] == r["digest"] else "reused"
        if verdict == "append":
            state["next"] = (seq + 1) % wrap if wrap else seq + 1
            recent[seq] = r["digest"]
            if len(recent) > WINDOW:
                del recent[next(iter(recent))]
        yield r["shard"], r["producer_id"], seq, r["arrival"], verdict

    rows = sends.select("shard", "producer_id", "sequence", "arrival", batch_digest(F.array("payload")).alias("digest"))
    return ordered_fold(rows, ["shard", "producer_id"], ["arrival"], dict, step, "shard int, producer_id long, sequence long, arrival long, verdict string")


def producer_lru(sends: DataFrame, keep: int) -> DataFrame:
    """The producers of each shard that were used last, `keep` of them at most."""
    used = sends.groupBy("shard", "producer_id").agg(F.max("arrival").alias("last_used"))
    order = Window.partitionBy("shard").orderBy(F.desc("last_used"), "producer_id")
    return used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def quorum_offset(members: DataFrame, voters: list[str], alias: str) -> DataFrame:
    """What a majority of the leader and its voters holds: the k-th largest tail, none above the leader's, halted ones excluded."""
    need = (len(voters) + 1) // 2 + 1
    own = F.when(F.col("member").isin(voters) & ~F.col("halted"), F.least("reported", "tail"))
    held = F.sort_array(F.array_append(F.collect_list(own), F.max("tail")), asc=False)
    t = members.groupBy(*SHARD).agg(held.alias("held"), F.max("tail").alias("tail"))
    return t.select(*SHARD, F.when(F.size("held") >= need, F.col("held")[need - 1]).otherwise(F.lit(0)).alias(alias))


def quorum_offsets(members: DataFrame) -> DataFrame:
    """The quorum offset under the old voters, the new ones, and both at once, as while membership changes."""
    old, new = quorum_offset(members, ["f1", "f2"], "old_set"), quorum_offset(members, ["f2", "f3", "f4"], "new_set")
    return old.join(new, list(SHARD)).withColumn("both", F.least("old_set", "new_set"))


def promote(members: DataFrame) -> DataFrame:
    """The replica to promote: not halted, furthest ahead, the greatest name on ties."""
    fit = members.where(~F.col("halted"))
    return fit.groupBy(*SHARD).agg(F.max(F.struct("reported", "member")).alias("m")).select(*SHARD, F.col("m.member").alias("member"), F.col("m.reported").alias("reported"))


#: Shards and nodes that are scored at a time, in one task: every shard meets every node, in as many blocks as it takes.
SHARD_BLOCK, NODE_BLOCK = 1 << 10, 1 << 14


def _dealt(rows: DataFrame, keys: list[str], block: int, own: str) -> tuple[int, DataFrame]:
    """How many blocks of `block` rows or so rows are dealt to by their keys, and rows with the number of theirs."""
    blocks = max(1, -(-rows.count() // block))
    return blocks, rows.withColumn(own, F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))


def _met(rows: DataFrame, blocks: int, other: str) -> DataFrame:
    """rows once for each block of the other side."""
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def block_winners(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of the highest score for each shard (the greatest name on ties) in each block of nodes, and that score, its sign bit flipped so
    that signed order is the unsigned order. A task holds one block of shards and one of nodes."""
    names = shards.columns

    def run(own, others):
        import numpy as np
        import pyarrow as pa

        own = own.select(names).combine_chunks()
        node = sorted(n for n in others["node"].to_pylist() if n is not None)
        left = shard_hashes(*(own[c].to_pylist() for c in ("tenant", "namespace", "stream", "shard"))) if node else ()
        right, won, score = node_hashes(node), [], []
        for h in left:
            scores = rendezvous_scores(h, right)
            at = len(node) - 1 - int(scores[::-1].argmax())
            won.append(node[at])
            score.append(int((scores[at] ^ np.uint64(1 << 63)).view(np.int64)))
        return pa.table({**{c: own[c].slice(0, len(won)) for c in names}, "node": pa.array(won, pa.string()), "score": pa.array(score, pa.int64())})

    ns, s = _dealt(shards, names, SHARD_BLOCK, "_s")
    nn, n = _dealt(nodes.select("node"), ["node"], NODE_BLOCK, "_n")
    pairs = _met(s, nn, "_n").groupBy("_s", "_n").cogroup(_met(n, ns, "_s").groupBy("_s", "_n"))
    return pairs.applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shards.schema) + ", node string, score long")


def rendezvous(shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of the highest score for each shard, the greatest name on ties, and how many shards that node leads."""
    best = block_winners(shards, nodes).groupBy(*shards.columns).agg(F.max(F.struct("score", "node")).alias("b"))
    best = best.select(*shards.columns, F.col("b.node").alias("node"))
    return best.withColumn("leads", F.count(F.lit(1)).over(Window.partitionBy("node")))


def bounded_placement(shards: DataFrame, nodes: DataFrame, copies: int = 3) -> DataFrame:
    """Replica sets under a bounded load, in zones as far apart as there are: sequential over the sorted shards, since each depends on the load
    that those before it left. The fold holds the nodes, some hundred bytes each, and scores them for one shard at a time.

    A node at its cap (the even share, rounded up) is passed over while another is free; replicas prefer zones without a copy;
    a node without a zone is a zone of its own. unspread: the set covers fewer zones than it could.
    """

    def make() -> dict:
        return {"nodes": [], "zones": [], "n": 0}

    def gathered(state: dict) -> None:
        import numpy as np

        codes: dict[str, int] = {}
        state["zone"] = np.array([codes.setdefault(z or n, len(codes)) for n, z in zip(state["nodes"], state["zones"])], np.int64)
        state["offered"] = len(codes)
        names: dict[str, int] = {}
        state["id"] = np.array([names.setdefault(n, len(names)) for n in state["nodes"]], np.int64)
        state["hash"], state["load"], state["zones"] = node_hashes(state["nodes"]), np.zeros(len(names), np.int64), None

    def step(state: dict, r: dict):
        import numpy as np

        if r["kind"] == 0:
            state["nodes"].append(r["node"])
            state["zones"].append(r["zone"])
            return
        if "hash" not in state:
            gathered(state)
        nodes, zone, ids, load = state["nodes"], state["zone"], state["id"], state["load"]
        if not nodes:
            return
        state["n"] += copies
        cap = -(-state["n"] // len(nodes))
        scores = rendezvous_scores(shard_hashes(*([r[c]] for c in ("tenant", "namespace", "stream", "shard")))[0], state["hash"])
        free, apart, room = np.ones(len(nodes), bool), np.ones(len(nodes), bool), load[ids] < cap
        chosen, zones = [], set()
        for _ in range(min(copies, len(load))):
            for fit in (apart & room, apart, free & room, free):
                if len(spots := np.flatnonzero(fit)):
                    break
            best = int(spots[len(spots) - 1 - int(scores[spots][::-1].argmax())])  # nodes come in order of names: the greatest on ties
            chosen.append(nodes[best])
            zones.add(int(zone[best]))
            load[ids[best]] += 1
            free &= ids != ids[best]
            apart &= free & (zone != zone[best])
        yield r["stream"], r["shard"], chosen[0], chosen[1:], len(zones), len(zones) < min(len(chosen), state["offered"])

    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    names = ["tenant", "namespace", "stream"]
    first = nodes.select(F.lit(0).alias("kind"), *none(*names), F.lit(None).cast("int").alias("shard"), "node", "zone")
    then = shards.select(F.lit(1).alias("kind"), *names, "shard", *none("node", "zone"))
    rows = first.unionByName(then).withColumn("all", F.lit(1))
    return ordered_fold(rows, ["all"], ["kind", *names, "shard", "node", "zone"], make, step, "stream string, shard int, leader string, replicas array<string>, zones int, unspread boolean")


def conditional_publish(attempts: DataFrame) -> DataFrame:
    """Outcome of appends that name the tail they expect (null: any): an ordered fold per shard. A refusal carries the tail."""

    def step(state: dict, r: dict):
        tail = state.get("tail", 0)
        applied = r["expected"] is None or r["expected"] == tail
        if applied:
            state["tail"] = tail + r["records"]
        yield r["stream"], r["shard"], r["arrival"], applied, tail if applied else None, state.get("tail", 0)

    return ordered_fold(attempts, list(SHARD), ["arrival"], dict, step, "stream string, shard int, arrival long, applied boolean, first_offset long, tail long")


#: The most records and bytes of one poll, and records of a group that may be in flight on a shard.
POLL_RECORDS, POLL_BYTES, IN_FLIGHT = 1000, 4 << 20, 10_000


class Deliveries:
    """The queue of one group on one shard: what is claimed, until when, and what is settled.

    A claim lapses at its deadline and its record is owed again. A poll hands out what is owed before what is new, in order of offsets, within
    the bounds of a poll and of what may be in flight; a record over the bound of attempts becomes a dead letter instead. Only what was
    handed out is acknowledged or given back (with a delay); a claim is extended by who holds it, unless it lapsed or was given back.
    """

    def __init__(self, visibility_ms: int, bound: int):
        self.visibility_ms, self.bound = visibility_ms, bound
        self.claims: dict[int, dict] = {}
        self.settled: set[int] = set()  # at or above cursor
        self.cursor = 0
        self.sizes: dict[int, int] = {}  # of records that aren't settled
        self.new: deque[int] = deque()  # offsets that were never handed out
        self._find()

    def _find(self) -> None:
        """What finds claims without looking at all of them: deadlines of those in flight, and those owed by offset. An entry that its claim has
        left behind (settled, handed out again, given back, extended) is passed over when its turn comes."""
        self.deadlines = [(c["until"], o) for o, c in self.claims.items()]
        self.owed: list[int] = []
        self.lapsed: set[int] = set()  # the offsets in owed that count
        heapify(self.deadlines)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("deadlines", "owed", "lapsed")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._find()

    def publish(self, offset: int, size: int) -> None:
        self.sizes[offset] = size
        self.new.append(offset)

    def settle(self, offset: int) -> None:
        self.claims.pop(offset, None)
        self.lapsed.discard(offset)
        self.sizes.pop(offset, None)
        self.settled.add(offset)
        while self.cursor in self.settled:
            self.settled.discard(self.cursor)
            self.cursor += 1

    def _until(self, offset: int, until: int) -> None:
        self.lapsed.discard(offset)
        heappush(self.deadlines, (until, offset))

    def _lapse(self, now: int) -> None:
        """Claims whose deadline has come are owed. Time doesn't go back."""
        while self.deadlines and self.deadlines[0][0] <= now:
            until, offset = heappop(self.deadlines)
            c = self.claims.get(offset)
            if c and c["until"] == until and offset not in self.lapsed:
                self.lapsed.add(offset)
                heappush(self.owed, offset)
        while self.owed and self.owed[0] not in self.lapsed:
            heappop(self.owed)

    def poll(self, now: int, consumer: str, most: int, visibility_ms: int | None = None):
        """(offset, result, attempts) of what the poll gives."""
        most, room, given = min(most, POLL_RECORDS), POLL_BYTES, 0
        self._lapse(now)
        flying = len(self.claims) - len(self.lapsed)
        while self.owed or self.new:
            offset = self.owed[0] if self.owed else self.new[0]
            c = self.claims.get(offset)
            dead = c and c["attempts"] >= self.bound
            size = self.sizes.get(offset, 0)
            if not dead and (given >= most or flying >= IN_FLIGHT or (given and size > room)):
                break
            if self.owed:
                self.lapsed.discard(offset)
                while self.owed and self.owed[0] not in self.lapsed:
                    heappop(self.owed)
            else:
                self.new.popleft()
            if dead:
                self.settle(offset)
                yield offset, "dead_letter", c["attempts"]
                continue
            attempts, until = c["attempts"] + 1 if c else 1, now + (visibility_ms or self.visibility_ms)
            self.claims[offset] = {"until": until, "attempts": attempts, "holder": consumer, "delayed": False}
            self._until(offset, until)
            given, flying, room = given + 1, flying + 1, room - size
            yield offset, "redelivered" if c else "delivered", attempts

    def answer(self, event: str, now: int, offset: int, consumer: str, delay_ms: int) -> str:
        c = self.claims.get(offset)
        if c is None:
            return "ignored"
        if event in ("ack", "dead_letter"):
            self.settle(offset)
            return "acked" if event == "ack" else "dead_letter"
        if event == "nack":
            c.update(until=now + delay_ms, delayed=True)
            self._until(offset, c["until"])
            return "owed"
        if now >= c["until"] or c["holder"] != consumer or c["delayed"]:
            return "ignored"
        c["until"] = now + self.visibility_ms
        self._until(offset, c["until"])
        return "extended"


def happen(queue: Deliveries, r: dict) -> list[tuple]:
    """The rows that one event gives."""
    at = (r["stream"], r["shard"], r["at_ms"], r["seq"], r["event"])
    if r["event"] == "publish":
        queue.publish(r["offset"], r["size"])
        return []
    if r["event"] == "poll":
        return [(*at, offset, result, attempts) for offset, result, attempts in queue.poll(r["at_ms"], r["consumer"], r["most"])]
    result = queue.answer(r["event"], r["at_ms"], r["offset"], r["consumer"], r["delay_ms"])
    held = queue.claims.get(r["offset"])
    return [(*at, r["offset"], result, held["attempts"] if held else None)]


def queue_claims(events: DataFrame, visibility_ms: int, bound: int = 5) -> DataFrame:
    """What becomes of a group's polls and answers on every shard: an ordered fold.

    events: stream, shard, at_ms, seq (order among events of a time), event (publish, poll, ack, nack, extend, dead_letter), offset, size, consumer, most
    (records of a poll), delay_ms. A row for each record that a poll gives, and for each answer.
    """
    schema = "stream string, shard int, at_ms long, seq long, event string, offset long, result string, attempts int"
    return ordered_fold(events, list(SHARD), ["at_ms", "seq"], lambda: Deliveries(visibility_ms, bound), happen, schema)


#: How far a tenant's balance may fall below zero, in seconds of its rate.
MOST_DEBT_S = 5.0


def tenant_rate(sends: DataFrame, msgs_per_sec: float, bytes_per_sec: float, burst_s: float) -> DataFrame:
    """Token buckets of messages and of bytes per tenant, debt allowed: a publish is admitted unless a balance is below zero, and then takes
    its whole cost. An ordered fold per tenant; a rate of 0 is no bound.

    sends: tenant, at_us, msgs, bytes. wait_ms: how long a refused tenant has to wait until no balance is below zero, rounded up.
    """
    import math

    rates = [r for r in (msgs_per_sec, bytes_per_sec)]

    def step(state: dict, r: dict):
        elapsed = max(0, r["at_us"] - state.get("at", r["at_us"])) / 1e6
        caps = [max(rate * burst_s, 1.0) for rate in rates]
        tokens = [min(t + elapsed * rate, cap) for t, rate, cap in zip(state.get("tokens", caps), rates, caps)]
        wait = max((math.ceil(-t / rate * 1000) for t, rate in zip(tokens, rates) if rate and t < 0), default=0)
        if not wait:
            tokens = [max(t - cost, -rate * MOST_DEBT_S) for t, cost, rate in zip(tokens, (r["msgs"], r["bytes"]), rates)]
        state.update(tokens=tokens, at=max(r["at_us"], state.get("at", r["at_us"])))
        yield r["tenant"], r["at_us"], r["msgs"], r["bytes"], not wait, wait

    return ordered_fold(sends, ["tenant"], ["at_us", "bytes"], dict, step, "tenant string, at_us long, msgs long, bytes long, admitted boolean, wait_ms long")


def dead_letter_list(groups: DataFrame) -> DataFrame:
    """The dead letters of every group, a row each, in order of offsets; groups: shard, grp, dead (group_fold's rows)."""
    return groups.select("shard", "grp", F.explode(F.array_sort("dead")).alias("offset"))


def attempts_of(claims: DataFrame) -> DataFrame:
    """Claims (shard, grp, offset, idx) with the number of the attempt, and whether it is a redelivery."""
    order = Window.partitionBy("shard", "grp", "offset").orderBy("idx")
    return claims.withColumn("attempt", F.row_number().over(order)).withColumn("redelivered", F.col("attempt") > 1)
