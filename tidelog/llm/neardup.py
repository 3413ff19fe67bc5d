"""Near-duplicates at a Jaccard similarity of word shingles: SimHash candidates by pigeonring chains, each pair verified exactly.

A text is the set of its distinct five-word shingles (a shorter text is one shingle); texts of the same set are one node. At a
similarity of 0.8 two SimHashes differ in 14 % of their bits, about nine of 64, too unsteady a number to filter by; so a fingerprint here
has 512 bits, of which such a pair differs in 72 with a deviation of 8.4, and a distance of at most DISTANCE = 92 loses one in a hundred.

The 512 bits are a ring of 64 segments of a byte. A chain starts where three consecutive segments are equal, which is the key of the
index; its next eight segments are tested prefix by prefix against the proportional budgets l * 92 / 64, then the whole
Hamming distance, and last the exact similarity. The budgets alone would let the first segments differ by a bit or two; to demand that
they are equal makes the index a join, and is paid for by many starts: 21 chains that don't overlap in each of
ORDERS = 10 fixed orders of the ring. Measured on 3,000 pairs each, 0.954 of the pairs at a similarity of exactly 0.8 are found by a chain of
their own, 0.978 at 0.82, 0.992 at 0.85, all at 0.9 (a test holds this); in a group of copies a missed link is mostly made up for by others.

Pairs whose chain holds are never rows of a table. They make families, components over chains that hold, which are found from one row per
member of a bucket. A family is dealt in blocks, and each two blocks meet in a task, which tests all their pairs by distance and exact
similarity until they are connected, and gives back no more links than it has members.

Defined cases: those of simhash; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import broadcast_if_small, chunks, cut, join_skewed, mapped, release, worker_cache
from tidelog.llm.simhash import chain_holds, components, first_of_each, with_components

SHINGLE, SEGMENTS, EQUAL, ORDERS, DISTANCE = 5, 64, 3, 10, 92
#: Sets of fewer shingles reach 4/5 with equal sets only.
LEAST = 4
#: A family has blocks of some BLOCK texts, but no more than BLOCKS of them unless one would hold more than BLOCK_SHINGLES shingles.
BLOCK, BLOCKS, BLOCK_SHINGLES = 256, 16, 1 << 20
WORDS = [f"f{i}" for i in range(SEGMENTS // 8)]


def _sets(text: str | None, shingle: int):
    """The distinct shingles of a text as ascending 64-bit hashes."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = {digest(b" ".join(w), 42) for w in zip(*(words[k:] for k in range(shingle)))} or {digest(b" ".join(words), 42)}
    return np.sort(np.fromiter(own, np.uint64, len(own)))


def _node_of(hashes) -> int:
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def signs():
    """The votes of a shingle: of each of the eight bytes of its hash, by the byte's value, one vote a bit. For and against are
    balanced over the values, so that unlike shingles don't pull all texts the same way."""
    import numpy as np

    order = np.random.default_rng(29).random((8, 256, SEGMENTS * 8)).argsort(axis=1)
    return np.where(order < 128, np.float32(1), np.float32(-1)).reshape(8 * 256, SEGMENTS * 8)


def wide_fingerprints(sets: list, votes):
    """The fingerprints of sets of shingle hashes as rows of bytes: the sign of the sum of their shingles' votes."""
    import numpy as np

    out = np.zeros((len(sets), SEGMENTS), np.uint8)
    places = np.arange(8, dtype=np.int64) * 256
    for at in range(0, len(sets), 64):
        part = sets[at : at + 64]
        tally = np.stack([np.bincount((s.astype("<u8").view(np.uint8).reshape(-1, 8) + places).reshape(-1), minlength=2048) for s in part])
        out[at : at + 64] = np.packbits(tally.astype(np.float32) @ votes > 0, axis=1, bitorder="little")
    return out


def _sketch_batches(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        votes = worker_cache("simhash votes", signs)
        for part in chunks(batches, "text", 1 << 19):
            sets = [_sets(t, shingle) for t in part.column("text").to_pylist()]
            words = wide_fingerprints(sets, votes).view("<i8")
            columns = [part.column("doc_id"), pa.array([_node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(words[:, i]) for i in range(len(WORDS)))], names=["doc_id", "node", "n", *WORDS])

    return run


def chains(words):
    """(chain's number, key, following eight segments) for every chain of fingerprints (rows of eight numbers)."""
    import numpy as np

    octets = np.ascontiguousarray(words, dtype="<i8").view(np.uint8)
    rng = np.random.default_rng(31)
    for n in range(ORDERS):
        ring = octets[:, rng.permutation(SEGMENTS)]
        ring = np.concatenate([ring, ring[:, : EQUAL + 8]], axis=1)
        for start in range(0, SEGMENTS - EQUAL + 1, EQUAL):
            key = sum(ring[:, start + i].astype(np.int64) << (8 * i) for i in range(EQUAL))
            yield n * SEGMENTS + start, key, np.ascontiguousarray(ring[:, start + EQUAL : start + EQUAL + 8]).view("<i8").reshape(-1)


def _key_batches(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            node = part.column("node")
            words = np.stack([part.column(w).to_numpy(zero_copy_only=False) for w in WORDS], axis=1)
            for number, key, following in chains(words):
                yield pa.RecordBatch.from_arrays([pa.array(key | (number << 32)), node, pa.array(following)], names=["k", "node", "bits"])
    release()


def _shingle_batches(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in chunks(batches, "text", 1 << 19):
            sets = [_sets(t, shingle) for t in part.column("text").to_pylist()]
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_node_of(s) for s in sets], pa.int64()), lists], names=["node", "shingles"])

    return run


def _merge_batches(batches: Iterator) -> Iterator:
    """(a, b): families of (k, node, bits, family), ascending by k, to be made one, as a chain of two of their members in a bucket holds."""
    import numpy as np
    import pyarrow as pa

    parent: dict = {}

    def root(x: int) -> int:
        while x in parent:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def merges(k, bits, family) -> Iterator:
        own, place = np.unique(family, return_inverse=True)
        family = np.fromiter(map(root, own.tolist()), np.int64, len(own))[place]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        several = np.minimum.reduceat(family, starts) != np.maximum.reduceat(family, starts)
        inside = np.repeat(several, np.diff(np.r_[starts, len(k)]))
        k, bits, family = k[inside], bits[inside], family[inside]
        at, away = np.arange(len(k)), 0
        while len(at):  # each member and the one `away` places after it
            away += 1
            at = at[at + away < len(k)]
            at = at[k[at] == k[at + away]]
            near = at[family[at] != family[at + away]]
            apart = (bits[near] ^ bits[near + away]).view(np.uint64)
            holds = np.ones(len(near), bool)
            for n in range(1, 9):
                holds &= np.bitwise_count(apart & np.uint64((1 << 8 * n) - 1)) <= (EQUAL + n) * DISTANCE // SEGMENTS
            near, found = near[holds], False
            for a, b in zip(family[near].tolist(), family[near + away].tolist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)], found = min(a, b), True
                    yield a, b
            if found:
                own, place = np.unique(family, return_inverse=True)
                family = np.fromiter(map(root, own.tolist()), np.int64, len(own))[place]

    def table(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rest = [np.empty(0, np.int64)] * 3
    for batch in batches:
        if batch.num_rows:
            rest = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("k", "bits", "family"))]
            whole = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on
            if whole:
                yield table(list(merges(*(r[:whole] for r in rest))))
                rest = [r[whole:] for r in rest]
    if len(rest[0]):
        yield table(list(merges(*rest)))
    release()


def families(nodes: DataFrame) -> DataFrame:
    """(node, root): nodes (node and words) that a chain that holds connects to another, by components over such chains."""
    keys = nodes.transform(mapped, _key_batches, "k long, node long, bits long")
    order = Window.partitionBy("k").orderBy("node")
    rows = keys.withColumn("one", F.first(F.struct("node", "bits")).over(order)).withColumn("next", F.lead("node").over(order))
    shared = cut(rows.where("one.node <> node OR next IS NOT NULL"))
    near = chain_holds(F.col("bits").bitwiseXOR(F.col("one.bits")), 8, DISTANCE, SEGMENTS, EQUAL)
    # one link for each node, which leaves few families to the rest
    hooks = cut(shared.where(F.col("one.node") != F.col("node")).where(near).groupBy(F.col("node").alias("b")).agg(F.min("one.node").alias("a")).select("a", "b"))
    rooted = shared.select("k", "node", "bits").join(components(hooks), "node", "left").select("k", "node", "bits", F.coalesce("root", "node").alias("family"))
    merged = rooted.repartition("k").sortWithinPartitions("k").transform(mapped, _merge_batches, "a long, b long")
    return components(cut(hooks.unionByName(cut(merged.distinct()))))


def _block_links(group):
    """(a, b): links that connect what links between two blocks of a family (or within one) connect; group: their members, as a table."""
    import numpy as np
    import pyarrow as pa

    node, block = (group.column(c).to_numpy() for c in ("node", "block"))
    words = np.stack([group.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
    lists = group.column("shingles").combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    sets, n = [flat[i:j] for i, j in zip(ends[:-1], ends[1:])], np.diff(ends).astype(np.int64)
    # how many shingles of a text any other here has: no pair has more in common
    _, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    most = np.add.reduceat((times[where] > 1).astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
    able = np.flatnonzero(most * 5 >= n * 4)
    low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
    left, right = able[block[able] == low], able[block[able] == high]
    part, links = np.arange(len(node)), []
    for place, i in enumerate(left):
        others = right[place + 1 :] if low == high else right
        others = others[(part[others] != part[i]) & (np.minimum(most[others], most[i]) * 9 >= (n[others] + n[i]) * 4)]
        apart = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
        order = np.argsort(apart, kind="stable")
        others = others[order[apart[order] <= DISTANCE]]
        while len(others):  # the nearest first; those that are connected by then need no test
            now, others = others[:16], others[16:]
            theirs = np.concatenate([sets[j] for j in now])
            found = np.searchsorted(sets[i], theirs)
            found = sets[i][np.minimum(found, n[i] - 1)] == theirs
            common = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(n[now])[:-1]])
            for j in now[common * 9 >= (n[now] + n[i]) * 4]:  # common / (n + n - common) is at least 4/5
                if part[j] != part[i]:
                    links.append((int(node[i]), int(node[j])))
                    part[part == part[j]] = part[i]
            others = others[part[others] != part[i]]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id): one row per row of docs; component_id is the smallest id reachable over pairs at 0.8 or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(texts.transform(mapped, _sketch_batches(shingle), "doc_id long, node long, n long, " + ", ".join(f"{w} long" for w in WORDS)))
    firsts = [F.first(c).alias(c) for c in ("n", *WORDS)]
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *firsts))

    members = cut(nodes.join(families(nodes.where(F.col("n") >= LEAST).select("node", *WORDS)), "node").drop("copies"))
    number = F.greatest(F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(BLOCKS)), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    dealt = members.join(members.groupBy("root").agg(number.alias("blocks")), "root")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).drop("rep")

    again = texts.join(broadcast_if_small(members.select(F.col("rep").alias("_id")).distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = again.transform(mapped, _shingle_batches(shingle), "node long, shingles array<long>")
    sets = cut(sets.join(broadcast_if_small(members.select("node")), "node", "left_semi").dropDuplicates(["node"]))
    met = dealt.drop("n").join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")
    links = cut(met.groupBy("root", "low", "high").applyInArrow(_block_links, "a long, b long").distinct())

    table = with_components(nodes.select("node", "rep", F.col("copies").alias("n")), links, "node")
    return join_skewed(rows.select("doc_id", "node"), table, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near duplicates: that with the smallest id."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col), id_col)
