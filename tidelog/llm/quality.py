"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words (split at white space) make two streams: the words themselves, lower-cased letters only, and their shapes
(capitals, small letters, digits and runs of the same mark, with a repeated word marked as such). Features are word 1- and
2-grams, shape 1- to 3-grams, and a few words about the whole text: its length, its share of repeated lines and of different
words. All are hashed to 2**bits weights; a text is the vector of its features' shares (times SCALE) and its score a sparse dot product.

Trained from a bounded sample of labelled rows: per_class rows of each label, of at most max_chars characters each.

Defined cases: null text counts as empty; an empty text has its length word only; repeated rows give repeated result rows;
an empty table gives an empty result; without both labels in the sample every score is the share of label 1 (0.5 without
labels); other columns are not read. Whole texts are scored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, crc_mod, labelled_sample, mapped, worker_cache

_LETTERS = re.compile(r"[\W\d_]+")
_RUNS = re.compile(r"([^\W\d_]+)|(\d+)|((.)\4*)", re.DOTALL)


SCALE = 8.0


def shape_of(word: str) -> str:
    """Letters as A (all capitals), Aa (capitalised) or a, digits as 0, and each run of a mark as the mark and its length up to 4."""

    def one(m: re.Match) -> str:
        if m[1]:
            return "A" if len(m[1]) > 1 and m[1].isupper() else "Aa" if m[1][0].isupper() else "a"
        return "0" if m[2] else m[4] + str(min(len(m[3]), 4))

    return _RUNS.sub(one, word)


class Features:
    """Hashed features of texts; word rows are kept in a bounded cache, emptied when full."""

    MARKS = ".,;:!?"

    def __init__(self, bits: int = 20, most: int = 300_000, most_chars: int = 20_000_000):
        self.bits, self.most, self.most_chars = bits, most, most_chars
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.shapes: dict = {}
        self.chars = 0
        self.rows = np.zeros((1 << 12, 2), np.uint64)

    def _row(self, word: str) -> tuple[int, int]:
        """The hashes of a word's letters and of its shape."""
        import xxhash

        core = word.rstrip(self.MARKS)
        if core.isalpha():  # most words: letters, and marks after them, whose shapes are few
            kind = "A" if len(core) > 1 and core.isupper() else "Aa" if core[0].isupper() else "a"
            key, letters = (kind, word[len(core) :]), core.lower()
        else:
            key, letters = word, _LETTERS.sub("", word).lower()
        shape = self.shapes.get(key)
        if shape is None:
            shape = xxhash.xxh64_intdigest(shape_of(word), 2)
            if len(self.shapes) < 100_000:
                self.shapes[key] = shape
        return xxhash.xxh64_intdigest(letters, 1), shape

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        held, total = len(self.known), len(self.known) + len(words)
        if total > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(total, 2 * len(self.rows)) - len(self.rows), 2), np.uint64)])
        if words:
            self.rows[held:total] = np.array(list(map(self._row, words)), np.uint64)
        self.known.update(zip(words, range(held, total)))
        self.chars += sum(map(len, words))

    def indices(self, texts: list[str]):
        """(index, text) of every feature of some texts, repeats included; all texts of a slice are taken together."""
        from itertools import chain

        import numpy as np
        import xxhash

        split = [t.split() for t in texts]
        if len(self.known) > self.most or self.chars > self.most_chars:
            self.clear()
        known = self.known
        self._learn(list(set(chain.from_iterable(split)).difference(known)))
        sizes = np.array([len(words) for words in split], np.int64)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        word, shape = self.rows[at, 0], self.rows[at, 1].copy()
        two = owner[1:] == owner[:-1]  # the word and the one after it are of one text
        three = two[1:] & two[:-1]
        shape[1:][two & (word[1:] == word[:-1])] ^= np.uint64(0x9E3779B97F4A7C15)
        mix = np.uint64(0xFF51AFD7ED558CCD)
        pairs = shape[:-1] * mix + shape[1:]
        extra, extra_owner = [], []
        for i, (text, words) in enumerate(zip(texts, split)):
            lines = [x for x in text.split("\n") if x.strip()]
            whole = [f"length {len(words).bit_length()}"]
            if lines:
                whole.append(f"lines {4 * (len(lines) - len(set(lines))) // len(lines)} {min(len(lines).bit_length(), 3)}")
                whole.append(f"different {8 * len(set(words)) // len(words)} {min(len(words).bit_length(), 8)}")
            times = max(1, len(words) // 4)
            extra += [xxhash.xxh64_intdigest(x, 3) for x in whole] * times
            extra_owner += [i] * (times * len(whole))
        parts = [word, (word[:-1] * mix + word[1:])[two], shape, (pairs * mix + np.uint64(1))[two], (pairs[:-1] * mix + shape[2:] + np.uint64(2))[three], np.array(extra, np.uint64)]
        hashes = np.concatenate(parts)
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xC4CEB9FE1A85EC53)
        owners = np.concatenate([owner, owner[1:][two], owner, owner[1:][two], owner[2:][three], np.array(extra_owner, np.int64)])
        return (hashes >> np.uint64(64 - self.bits)).view(np.int64), owners

    def of(self, text: str):
        """(indices, values) of a text; indices ascend and are distinct."""
        import numpy as np

        all_, _ = self.indices([text])
        index, counts = np.unique(all_, return_counts=True)
        return index, SCALE * counts / len(all_)


class Regression:
    """Weights of a logistic regression with per-coordinate FTRL-proximal updates."""

    def __init__(self, bits: int = 20, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        import numpy as np

        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias = self.bias_n = 0.0

    def _weights(self, index):
        import numpy as np

        z, n = self.z[index], self.n[index]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list, labels: list[int], weights: list[float], epochs: int = 4, seed: int = 7) -> None:
        import numpy as np

        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                index, values = rows[i]
                w = self._weights(index)
                p = 1 / (1 + np.exp(-np.clip(float(w @ values) + self.bias, -35, 35)))
                g = (p - labels[i]) * weights[i]
                grads = g * values
                self.z[index] += grads - (np.sqrt(self.n[index] + grads * grads) - np.sqrt(self.n[index])) / self.alpha * w
                self.n[index] += grads * grads
                self.bias_n += g * g
                self.bias -= 0.5 * g / (1 + np.sqrt(self.bias_n))

    def freeze(self) -> None:
        import numpy as np

        self.w = self._weights(np.arange(1 << self.bits)).astype(np.float32)
        del self.z, self.n

    def score(self, texts: list[str], features: Features):
        """The scores of texts: of each the sparse dot product of its features' shares and the weights."""
        import numpy as np

        index, owner = features.indices(texts)
        sums, sizes = np.bincount(owner, self.w[index], len(texts)), np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(SCALE * sums / sizes + self.bias, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, max_chars: int = 20_000, held: int = 0, folds: int = 5) -> Regression | float:
    """A model from labelled rows whose crc32(id) mod folds isn't held; the share of label 1 if one label is missing."""
    own = labels.where(F.coalesce(crc_mod(id_col, folds) != held, F.lit(False)))
    totals = {int(r[0]): r[1] for r in own.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    sample = labelled_sample(docs, own, label, id_col, text_col, per_class, max_chars)
    counts = {y: sum(1 for r in sample if r[2] == y) for y in (0, 1)}
    if not all(counts.values()):
        return totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    features, model = Features(), Regression()
    rows = [features.of(t or "") for _, t, _ in sample]
    share = {y: totals[y] / sum(totals.values()) * len(sample) / counts[y] for y in (0, 1)}
    model.fit(rows, [y for *_, y in sample], [share[y] for *_, y in sample])
    model.freeze()
    return model


def _score(model, version: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = worker_cache("quality", Features, version)
        for part in chunks(batches, "text", 1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            scores = [model] * len(texts) if isinstance(model, float) else model.score(texts, features)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, model: Regression | float, id_col: str = "doc_id", text_col: str = "text", held: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.transform(mapped, _score(model, uuid.uuid4().hex), "doc_id long, held_out boolean, score double")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, train(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
