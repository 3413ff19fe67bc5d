"""Benchmark decontamination by winnowing; DataFrame functions only.

Words are lower-cased (A-Z). A document keeps, of every `window` consecutive words, the least hash of the k-grams within
it (ties: the rightmost), so every shared span of `window` words leaves at least one common fingerprint: the benchmark
side holds all its k-grams. A fingerprint is the upper 39 bits of a hash and the lower 24 bits of the position. Hits are
joined, then extended word by word along their diagonal; only whole windows count. Items shorter than a window
are one window each: for each such length that occurs the documents' grams of that length are made in the same pass and joined alike.

The benchmark's fingerprints, and the names of documents with hits, are broadcast only after they were counted (BROADCAST_ROWS);
beyond that the joins shuffle. Only texts with a hit are read again and extended: a row for each document and item, with the
diagonals of its hits, at most as many as both have words. Documents with equal id and equal text are looked up as one.

Defined cases: null texts have no words; empty tables give no hits; repeated rows give repeated result rows; a null id is
kept; texts of over 2**24 words are handled, as positions are then tried at every multiple; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import broadcast_if_small, cut, let

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 2_000_000
_POSITIONS = (1 << 24) - 1


def words_of(text: Column) -> Column:
    lowered = F.translate(text, UPPER, LOWER)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def _grams(words: Column, k: int, length: int) -> Column:
    """The fingerprint of each k-gram, for windows of that length, by position; [] for fewer than k words."""
    last = F.size(words) - k

    def one(i: Column) -> Column:
        h = F.xxhash64(F.lit(length), *(F.get(words, i + j) for j in range(k)))
        return h.bitwiseAND(F.lit(0x7FFFFFFFFF000000)).bitwiseOR(F.lit(_POSITIONS) - i.cast("long").bitwiseAND(F.lit(_POSITIONS)))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column, span: int) -> Column:
    """The least of every span consecutive fingerprints."""
    if span == 1:
        return grams
    last = F.size(grams) - span
    least = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.least(*(F.get(grams, i + j) for j in range(span))))
    return F.when(last >= 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _hash_of(fingerprint: Column) -> Column:
    return F.shiftright(fingerprint, 24)


def _position(fingerprint: Column) -> Column:
    return (F.lit(_POSITIONS) - fingerprint.bitwiseAND(F.lit(_POSITIONS))).cast("int")


def _names(id_: Column, text: Column) -> list[Column]:
    """128 bits that name an id together with its text."""
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(text, F.lit(1), id_).alias("k2")]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """(k1, k2, n_hit, n_items, items_sha256) of the documents that hold a window; k1, k2 name id and text. Broadcast if it is small."""
    id_, text = F.col(id_col), F.col(text_col)
    name = _names(id_, text)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("iw")).where(F.size("iw") > 0).distinct()
    items = cut(items.withColumn("span", F.least(F.size("iw"), F.lit(window))))
    lengths = sorted(r["span"] for r in items.select("span").distinct().collect())  # at most `window` values
    if not lengths:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, n_hit long, n_items long, items_sha256 string")
    gram = {n: min(k, n) if n == window else n for n in lengths}
    own = reduce(lambda rest, n: F.when(F.col("span") == n, _grams(F.col("iw"), gram[n], n)).otherwise(rest), lengths, F.array().cast("array<bigint>"))
    index = items.select("item", F.explode(own).alias("f")).select("item", _position(F.col("f")).alias("q"), _hash_of(F.col("f")).alias("h"))
    marks = let(words_of(text), lambda words: F.flatten(F.array(*(let(_grams(words, gram[n], n), _winnowed(n - gram[n] + 1)) for n in lengths))))
    found = docs.select(*name, F.explode(marks).alias("f")).select("k1", "k2", _position(F.col("f")).alias("p"), _hash_of(F.col("f")).alias("h"))
    found = found.join(broadcast_if_small(cut(index), BROADCAST_ROWS), "h").select("k1", "k2", "item", (F.col("p") - F.col("q")).alias("diagonal"))
    found = cut(found.groupBy("k1", "k2", "item").agg(F.collect_set("diagonal").alias("diagonals")))
    names = broadcast_if_small(cut(found.select("k1", "k2").distinct()), BROADCAST_ROWS)
    texts = docs.select(*name, text.alias("text")).join(names, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    runs = texts.join(found, ["k1", "k2"]).join(items, "item").select("k1", "k2", "item", let(words_of(F.col("text")), _runs).alias("runs")).where(F.size("runs") > 0)
    per = runs.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.sort_array(F.collect_set("item")).alias("items"))
    verdict = per.select("k1", "k2", _covered(F.col("runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return broadcast_if_small(cut(verdict), BROADCAST_ROWS // 4)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256): one row per row of docs. options: those of hits()."""
    id_, text = F.col(id_col), F.col(text_col)
    found = hits(docs, benchmark, id_col, text_col, **options)
    base = docs.select(id_.alias("doc_id"), *_names(id_, text), F.size(words_of(text)).cast("long").alias("n_words"))
    out = base.join(found, ["k1", "k2"], "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", "n_words", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", none).alias("items_sha256"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a window of benchmark."""
    found = hits(docs, benchmark, id_col, text_col, **options).select(F.struct("k1", "k2").alias("_name"))
    return docs.withColumn("_name", F.struct(*_names(F.col(id_col), F.col(text_col)))).join(found, "_name", "left_anti").select(*docs.columns)


def _winnowed(span: int):
    return lambda grams: _winnow(grams, span)


def _runs(words: Column) -> Column:
    """Where an item's windows occur in the words along the hits' diagonals: (first, last) word of each run, ascending."""
    size, span = F.size("iw"), F.col("span")
    steps = F.transform("diagonals", lambda d: F.sequence(d, F.greatest(d, F.size(words)), F.lit(_POSITIONS + 1)))

    def along(d: Column) -> Column:
        same = lambda s: F.forall(F.sequence(F.lit(0), span - 1), lambda j: F.coalesce(F.get(words, s + d + j) == F.get(F.col("iw"), s + j), F.lit(False)))
        return F.transform(F.filter(F.sequence(F.lit(0), size - span), same), lambda s: s + d)

    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(steps), along))))

    def joined(at: Column) -> Column:
        firsts = F.filter(at, lambda s, i: (i == 0) | (s - F.get(at, i - 1) > span))
        lasts = F.filter(at, lambda s, i: F.coalesce(F.get(at, i + 1) - s > span, F.lit(True)))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("a"), (b + span - 1).alias("b")))

    return let(starts, joined)


def _covered(runs: Column) -> Column:
    """How many words lie in runs, which ascend and may overlap."""
    start = F.struct(F.lit(-1).alias("upto"), F.lit(0).cast("long").alias("n"))
    add = lambda s, r: F.struct(F.greatest(s["upto"], r["b"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["upto"], r["a"] - 1)).cast("long")).alias("n"))
    return F.aggregate(runs, start, add, lambda s: s["n"])


def op9_decontam(spark, sf_dir: str) -> DataFrame:
    """Hit words and hit items of every document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
