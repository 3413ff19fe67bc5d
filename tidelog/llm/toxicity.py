"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from the labelled sample: words, and beginnings of words of 4 to 6 letters, that are at least `ratio` times as
frequent among toxic rows. Words are compared in lower case, without marks, and with look-alike digits and marks read
as letters. Features of a text: density and number of lexicon words (all, and the strongest), the strongest evidence, lexicon words
close to a second person pronoun, rates of capitals, exclamation marks, other punctuation and obfuscated words,
and length. Rows are described with the lexicon of the half they aren't in, the trees fitted, and their out-of-fold
scores calibrated by pool-adjacent-violators.

Trained from a bounded sample of labelled rows: per_class rows of each label, of at most max_chars characters each.

Defined cases: null text counts as empty; an empty text has features 0; repeated rows give repeated result rows; an empty table
gives an empty result; without both labels in the sample every score is the share of label 1 (0 without labels); other
columns are not read. Whole texts are scored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, crc_mod, labelled_sample, mapped, worker_cache

# Second person pronouns of English, German, French and Spanish; look-alikes of letters.
SECOND = frozenset("you your yours yourself youre du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_MARKS = re.compile(r"[\W\d_]+")
_HIDDEN = re.compile(r"[^\W\d_][\d@$!*#.\-_]+[^\W\d_]")
_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 33)


def plain(word: str) -> str:
    """A word without marks at its ends, look-alikes read as letters, and then letters only."""
    core = word.lower().strip(".,;:?!\"'()[]{}%&*#")
    return _MARKS.sub("", core.translate(ALIKE) if not core.isdigit() else core)


def units(word: str) -> list[str]:
    """The word, and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n)]


def learn_lexicon(texts: list[str], labels: list[int], ratio: float = 8.0, least: int = 4) -> dict[str, float]:
    """Log ratio of the share of toxic rows that hold a unit to that of the others, for units over ratio in at least `least` toxic rows."""
    import math

    seen = (Counter(), Counter())
    for text, y in zip(texts, labels):
        seen[y].update({u for w in {plain(x) for x in text.split()} if w for u in units(w)})
    n = (labels.count(0), labels.count(1))
    lexicon = {}
    for unit, c in seen[1].items():
        if c >= least:
            value = math.log(((c + 0.5) / (n[1] + 1)) / ((seen[0][unit] + 0.5) / (n[0] + 1)))
            if value >= math.log(ratio):
                lexicon[unit] = value
    return lexicon


class Describer:
    """Dense features of texts; what is known of a word is kept in a bounded cache, emptied when full."""

    NAMES = ("strong_density", "strong", "density", "number", "most", "sum", "near_you", "capitals", "exclamations", "punctuation", "obfuscated", "length")

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        import numpy as np

        self.lexicon, self.most = lexicon, most
        self.strong = float(np.quantile(list(lexicon.values()), 0.5)) if lexicon else 0.0
        self.known: dict[str, tuple[float, int, int]] = {}

    def _word(self, word: str) -> tuple[float, int, int]:
        """(evidence, second person, obfuscated)"""
        w = plain(word)
        evidence = max((self.lexicon.get(u, 0.0) for u in units(w)), default=0.0) if w else 0.0
        hidden = 1 if _HIDDEN.search(word) else 0
        got = (evidence, 1 if w in SECOND else 0, hidden)
        return NOTHING if got == NOTHING else got

    def of(self, text: str) -> list[float]:
        words = text.split()
        if not words:
            return [0.0] * len(self.NAMES)
        known = self.known
        if len(known) > self.most:
            known.clear()
        different = set(words)
        hits, seconds, hidden = {}, set(), 0
        for w in different:
            got = known.get(w)
            if got is None:
                got = known[w] = self._word(w)
            if got is not NOTHING:
                if got[0]:
                    hits[w] = got[0]
                if got[1]:
                    seconds.add(w)
                if got[2]:
                    hidden += 1
        number = strong = near = 0
        total = most = 0.0
        if hits:
            places = [(i, hits[w]) for i, w in enumerate(words) if w in hits]
            number, most, total = len(places), max(v for _, v in places), sum(v for _, v in places)
            strong = sum(v >= self.strong for _, v in places)
            if seconds:
                yours = [i for i, w in enumerate(words) if w in seconds]
                import bisect

                for i, _ in places:
                    j = bisect.bisect_left(yours, i - 5)
                    near += j < len(yours) and yours[j] <= i + 5
        raw = text.encode("utf-8", "surrogatepass")
        size, n = len(raw), len(words)
        capitals = size - len(raw.translate(None, _UPPER))
        marks = size - len(raw.translate(None, _PUNCTUATION))
        return [strong / n, strong, number / n, number, most, total, near, capitals / size, raw.count(b"!") / size, marks / size, hidden / len(different), n**0.25]


NOTHING = (0.0, 0, 0)


class Trees:
    """Gradient-boosted trees of a fixed depth over binned features, for the logistic loss."""

    def __init__(self, depth: int = 3, rounds: int = 50, rate: float = 0.2, bins: int = 32, least: float = 4.0, l2: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.least, self.l2 = depth, rounds, rate, bins, least, l2

    def _binned(self, x):
        import numpy as np

        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)

    def fit(self, x, y, weight) -> Trees:
        import numpy as np

        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._binned(x)
        self.start = float(np.log(max((weight * y).sum(), 1e-9) / max((weight * (1 - y)).sum(), 1e-9)))
        margin = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (p - y), weight * p * (1 - p)
            tree, node = [], np.zeros(len(y), np.int64)
            for level in range(self.depth):
                splits = []
                for k in range(1 << level):
                    at = np.flatnonzero(node == k)
                    best = (0.0, 0, 1 << 30)
                    if len(at):
                        total_g, total_h = g[at].sum(), h[at].sum()
                        for f, c in enumerate(self.cuts):
                            if not len(c):
                                continue
                            lg = np.cumsum(np.bincount(binned[at, f], g[at], len(c) + 1))[:-1]
                            lh = np.cumsum(np.bincount(binned[at, f], h[at], len(c) + 1))[:-1]
                            n = np.cumsum(np.bincount(binned[at, f], minlength=len(c) + 1))[:-1]
                            gain = lg**2 / (lh + self.l2) + (total_g - lg) ** 2 / (total_h - lh + self.l2) - total_g**2 / (total_h + self.l2)
                            gain[(n < self.least) | (len(at) - n < self.least)] = 0
                            j = int(gain.argmax())
                            if gain[j] > best[0] + 1e-12:
                                best = (float(gain[j]), f, j)
                    splits.append(best[1:])
                tree.append(splits)
                f, j = np.array(splits).T[:, node]
                node = node * 2 + (binned[np.arange(len(y)), f] > j)
            leaves = np.zeros(1 << self.depth)
            sums_g, sums_h = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            leaves = -self.rate * sums_g / (sums_h + self.l2)
            margin += leaves[node]
            self.trees.append(([np.array(s) for s in tree], leaves))
        return self

    def margin(self, x):
        import numpy as np

        binned = self._binned(x)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for levels, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for splits in levels:
                node = node * 2 + (binned[rows, splits[node, 0]] > splits[node, 1])
            out += leaves[node]
        return out


def isotonic(x, y, weight):
    """(knots, values) of the non-decreasing weighted least squares fit of y over x."""
    import numpy as np

    at = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted mean of y, weighted mean of x
    for i in at:
        blocks.append([weight[i], y[i], x[i]])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, v, c = blocks.pop()
            u = blocks[-1]
            total = u[0] + w
            blocks[-1] = [total, (u[0] * u[1] + w * v) / total, (u[0] * u[2] + w * c) / total]
    return np.array([b[2] for b in blocks]), np.array([b[1] for b in blocks])


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, texts: list[str], labels: list[int], share: dict[int, float]):
        import numpy as np

        half = [i % 2 for i in range(len(texts))]
        y = np.array(labels, float)
        weight = np.array([share[v] for v in labels])
        x = np.zeros((len(texts), len(Describer.NAMES)))
        for k in (0, 1):
            other = [i for i, h in enumerate(half) if h != k]
            describer = Describer(learn_lexicon([texts[i] for i in other], [labels[i] for i in other]))
            for i in (i for i, h in enumerate(half) if h == k):
                x[i] = describer.of(texts[i])
        out = np.zeros(len(texts))
        folds = np.arange(len(texts)) // 2 % 4
        for k in range(4):
            if len(set(y[folds != k])) == 2 and (folds == k).any():
                out[folds == k] = Trees().fit(x[folds != k], y[folds != k], weight[folds != k]).margin(x[folds == k])
        self.trees = Trees().fit(x, y, weight)
        self.knots, self.values = isotonic(out, y, weight)
        self.lexicon = learn_lexicon(texts, labels)

    def score(self, x):
        import numpy as np

        margin = self.trees.margin(x)
        calibrated = np.interp(margin, self.knots, self.values)
        return np.clip(0.999 * calibrated + 0.001 / (1 + np.exp(-margin)), 0, 1)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, max_chars: int = 20_000, held: int = 0, folds: int = 5) -> Model | float:
    """A model from labelled rows whose crc32(id) mod folds isn't held; the share of label 1 if one label is missing."""
    own = labels.where(F.coalesce(crc_mod(id_col, folds) != held, F.lit(False)))
    totals = {int(r[0]): r[1] for r in own.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    sample = labelled_sample(docs, own, label, id_col, text_col, per_class, max_chars)
    counts = {y: sum(1 for r in sample if r[2] == y) for y in (0, 1)}
    if not all(counts.values()):
        return totals.get(1, 0) / sum(totals.values()) if totals else 0.0
    share = {y: totals[y] / sum(totals.values()) * len(sample) / counts[y] for y in (0, 1)}
    return Model([t or "" for _, t, _ in sample], [y for *_, y in sample], share)


def _score(model, version: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fixed = isinstance(model, float)
        describer = None if fixed else worker_cache("toxicity", lambda: Describer(model.lexicon), version)
        for part in chunks(batches, "text", 4 << 20):
            texts = part.column("text").to_pylist()
            scores = np.full(len(texts), model) if fixed else model.score(np.array([describer.of(t or "") for t in texts]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", held: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.transform(mapped, _score(model, uuid.uuid4().hex), "doc_id long, held_out boolean, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
