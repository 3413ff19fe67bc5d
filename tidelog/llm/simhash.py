"""SimHash near-duplicates, linked by pigeonring filtering.

A fingerprint is cut into a ring of m segments. If two fingerprints differ in at most t bits, some segment starts a chain of
consecutive segments (around the ring) of which every prefix of l segments differs in at most l * t / m bits. As long as l * t < m
that is none: those first segments are equal, and are the key under which every fingerprint is indexed, once for each start.
Within a key's bucket the rest of the chain is tested prefix by prefix, and only then the whole Hamming distance.

`bucket_links` compares every member of a bucket with one representative first. Once those links are joined in components,
only members of different components are compared, so that a large group of near copies doesn't make all its pairs, and
still every pair of a bucket is either tested or connected already.

Defined cases: null text counts as empty; empty texts have fingerprint 0 and are linked like any other; repeated rows
give repeated result rows; an empty table gives an empty result; other columns are not read. Null ids are kept, in the
component of their fingerprint, whose id is the smallest id that isn't null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import broadcast_if_small, chunks, cut, join_skewed

BITS = 64


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for part in chunks(batches, "text", 1 << 20):
            counts = np.zeros((part.num_rows, BITS), np.int64)
            totals = np.ones(part.num_rows, np.int64)
            for i, text in enumerate(part.column("text").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                if not words:
                    continue
                if len(words) <= shingle:
                    hashes = [digest(b" ".join(words), seed)]
                else:
                    hashes = [digest(b" ".join(w), seed) for w in zip(*(words[k:] for k in range(shingle)))]
                totals[i] = len(hashes)
                octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
                for at in range(0, len(hashes), 1 << 16):
                    bits = np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little")
                    counts[i] += bits.sum(axis=0, dtype=np.uint32)
            fps = np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's word shingles, repeats included, as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle, seed), "doc_id long, fp long")


def equal_segments(max_distance: int, segments: int) -> int:
    """How many first segments of a chain the budgets demand to be equal."""
    return segments if max_distance == 0 else (segments - 1) // max_distance


def chain_holds(apart: Column, width: int, max_distance: int, segments: int, after: int = 0) -> Column:
    """Whether the prefixes of a chain stay within their budgets; apart: the differing bits of 64 / width segments, of which the first
    follows `after` equal ones."""
    holds = F.lit(True)
    for length in range(1, BITS // width + 1):
        mask = (1 << (length * width)) - 1
        own = apart.bitwiseAND(F.lit(mask)) if length * width < BITS else apart
        holds = holds & (F.bit_count(own) <= (after + length) * max_distance // segments)
    return holds


def ring_keys(fps: DataFrame, max_distance: int = 2, segments: int = 8) -> DataFrame:
    """(k, node, bits) of every fingerprint (column fp, distinct) and every start: the first segments of the chain, and the ring from there on."""
    if BITS % segments or not 0 <= max_distance < segments:
        raise ValueError("the ring needs segments of equal width, and max_distance < segments")
    width = BITS // segments
    held = min(equal_segments(max_distance, segments) * width, 48)
    fp = F.col("fp")
    starts = []
    for i in range(segments if max_distance else 1):
        ring = F.shiftrightunsigned(fp, i * width).bitwiseOR(F.shiftleft(fp, BITS - i * width)) if i else fp
        key = ring.bitwiseAND(F.lit((1 << held) - 1)).bitwiseOR(F.lit(i << 48).cast("long"))
        starts.append(F.struct(key.alias("k"), ring.alias("bits")))
    return fps.select(fp.alias("node"), F.explode(F.array(*starts)).alias("s")).select("s.k", "node", "s.bits")


def bucket_links(keys: DataFrame, near: Callable[[Column], Column], verified: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): links that connect all nodes which links within buckets connect. keys: k, node, bits, a node once in a bucket.

    near(differing bits) tells which pairs of a bucket may be linked, verified(pairs) which of those are.
    """
    order = Window.partitionBy("k").orderBy("node")
    first = F.first(F.struct("node", "bits")).over(order)
    rows = keys.withColumn("one", first).withColumn("next", F.lead("node").over(order))
    rows = rows.where("one.node <> node OR next IS NOT NULL")
    shared = cut(rows.select("k", "node", "bits", F.col("one.node").alias("first"), F.col("one.bits").alias("first_bits")))

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        return cut(verified(pairs) if verified else pairs)

    star = shared.where(F.col("node") != F.col("first")).where(near(F.col("bits").bitwiseXOR(F.col("first_bits"))))
    links = tested(star.select(F.col("first").alias("a"), F.col("node").alias("b")))
    rooted = shared.join(components(links), "node", "left").select("k", "node", "bits", F.coalesce("root", "node").alias("c"))
    # buckets of one component are done; of the others each pair of components, and then of their members
    parts = rooted.select("k", "c").distinct()
    several = parts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    mixed = cut(rooted.join(several, "k"))
    parts = mixed.select("k", "c").distinct()
    met = parts.select("k", F.col("c").alias("ca")).join(parts.select("k", F.col("c").alias("cb")), "k").where("ca < cb")
    left = mixed.select("k", F.col("c").alias("ca"), F.col("node").alias("a"), F.col("bits").alias("x"))
    right = mixed.select("k", F.col("c").alias("cb"), F.col("node").alias("b"), F.col("bits").alias("y"))
    across = met.join(left, ["k", "ca"]).join(right, ["k", "cb"]).where(near(F.col("x").bitwiseXOR(F.col("y"))))
    return cut(links.unionByName(tested(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (columns a, b), for every node that has a link.

    Rounds of large-star and small-star; the number of rounds grows with the logarithm of the longest path. Every round is
    checkpointed, and a node's neighbours are never gathered in one row.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 2, segments: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the smallest id reachable over links."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    width = BITS // segments
    links = bucket_links(ring_keys(groups.select("fp"), max_distance, segments), lambda apart: chain_holds(apart, width, max_distance, segments))
    table = with_components(groups, links, "fp")
    return join_skewed(rows, table, "fp").select("doc_id", "fp", "component_id")


def with_components(groups: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """groups (node, rep: the smallest id in it) with component_id, the smallest rep reachable over links."""
    found = components(links).withColumnRenamed("node", node).join(groups.select(node, "rep"), node)
    found = found.join(found.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select(node, "component_id")
    return cut(groups.join(found, node, "left").withColumn("component_id", F.coalesce("component_id", "rep")).drop("rep"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component of near duplicates: that with the smallest id. options: those of near_duplicates()."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component of found (doc_id, component_id): that whose id is the component's.

    The ids that go are broadcast where their number, once counted, allows it, so that texts aren't shuffled; else they are joined.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    per = cut(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.when(stays, 1)).alias("_stay"), F.count(F.lit(1)).alias("_rows")))
    nulls, repeats = per.agg(F.count(F.when(F.col("_id").isNull(), 1)), F.count(F.when((F.col("_stay") > 0) & (F.col("_rows") > 1), 1))).first()
    if nulls:
        rows = docs.join(per.where("_stay > 0").select("_id"), F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    else:
        goes = per.where("_stay = 0").select("_id")
        rows = docs.join(broadcast_if_small(goes), F.col(id_col) == F.col("_id"), "left_anti")
    return rows.dropDuplicates([id_col]) if repeats else rows


def hex_fingerprint(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
