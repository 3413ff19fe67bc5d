"""Language identification by interpolated Kneser-Ney character models.

A language's model is trained on the words of its sample: runs of letters, lower-cased, between two edge marks; a context
never leaves its word. Highest-order n-grams count occurrences, lower orders count distinct left neighbours, and each order
is discounted and interpolated with the one below, down to a uniform distribution. Interpolated log probabilities of all
n-grams that were seen are stored once for all languages: a sorted array of 64-bit hashes per order, and beside it one
row of log probabilities and back-off weights. A word's score is a sum over its characters, so it is looked up in
the arrays once and then kept by word in a bounded cache.

The language with the lowest cross-entropy per character wins. A text is rejected when its best cross-entropy is above a
limit that was calibrated on a part of the sample that the models didn't see: halfway between the largest value there and
the entropy of uniform characters, or mean + z * deviation / sqrt(words) if that is more. Texts without a letter, and null texts, are `und` and rejected.

Defined cases: an empty text is `und` with score 0; ties go to the language that sorts first; repeated rows give repeated
result rows; an empty table gives an empty result; without any labelled row every text is `und`; other columns are not
read. The sample is bounded: per_lang rows of each language (of the MOST_LANGUAGES most frequent labels), of at most max_chars characters each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, crc_mod, least_hashed, mapped, worker_cache

LETTERS = re.compile(r"[^\W\d_]+")
EDGE = "\x01"
ORDER = 5
MOST_LANGUAGES = 500  # the most frequent labels, should a table hold more


def _hash(codes, ends, order: int):
    """64-bit hashes of the n-grams of that order that end at the positions `ends`; codes: uint64 code points."""
    import numpy as np

    h = np.full(len(ends), 1469598103934665603 + order, np.uint64)
    for back in range(order - 1, -1, -1):
        h = (h ^ codes[ends - back]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h


def _codes(words: list[str]):
    """All words, each after an edge mark and before another, as code points; and where each word starts and ends."""
    import numpy as np

    joined = "".join(EDGE + w + EDGE for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return codes, ends - sizes, ends


class Models:
    """Kneser-Ney models of several languages; see the module's text."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, discount: float = 0.75):
        import numpy as np

        self.langs, self.order = sorted(samples), order
        tallies = []
        alphabet = set()
        for lang in self.langs:
            words = Counter(w for t in samples[lang] for w in LETTERS.findall(t.lower()))
            grams: list[Counter] = [Counter() for _ in range(order + 1)]
            for word, n in words.items():
                marked = EDGE + word + EDGE
                for at in range(1, len(marked)):
                    for k in range(1, min(order, at + 1) + 1):
                        grams[k][marked[at - k + 1 : at + 1]] += n
            alphabet |= set(grams[1])
            tallies.append(grams)
        self.most, self.mean, self.deviation, self.z = float("inf"), 0.0, 0.0, 0.0  # until calibrate()
        self.uniform = float(np.log(max(len(alphabet), 1)))
        self.floor = -np.log(max(len(alphabet), 1) * 4.0)
        self.tables = []
        backs: list[list[dict]] = []
        levels: list[list[dict]] = []
        for grams in tallies:
            counts = [Counter() for _ in range(order + 1)]
            counts[order] = grams[order]
            for k in range(1, order):
                for g in grams[k + 1]:
                    counts[k][g[1:]] += 1
                for g, n in grams[k].items():  # nothing stands before a word's first mark
                    if g[0] == EDGE:
                        counts[k][g] = n
            below, level, back = {}, [{}], [{}]
            for k in range(1, order + 1):
                total, kinds = Counter(), Counter()
                for g, n in counts[k].items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                weight = {c: discount * kinds[c] / total[c] for c in total}
                now = {}
                for g, n in counts[k].items():
                    rest = below.get(g[1:], 0.0) if k > 1 else np.exp(self.floor)
                    now[g] = (n - discount) / total[g[:-1]] + weight[g[:-1]] * rest
                level.append(now)
                back.append(weight)
                below = now
            levels.append(level)
            backs.append(back)
        for k in range(1, order + 1):
            grams_ = sorted({g for level in levels for g in level[k]})
            contexts = sorted({c for back in backs for c in back[k]}) if k > 1 else []
            for level, back in zip(levels, backs):  # what a language hasn't seen backs off once, here
                for g in grams_:
                    if g not in level[k]:
                        level[k][g] = back[k].get(g[:-1], 1.0) * (level[k - 1][g[1:]] if k > 1 else np.exp(self.floor))
            self.tables.append((*self._table(grams_, [level[k] for level in levels], k), *self._table(contexts, [back[k] for back in backs], k - 1)))
        self.back_empty = np.array([np.log(back[1].get("", 1.0)) for back in backs])

    def _table(self, grams: list[str], values: list[dict], order: int):
        """Sorted hashes, and the log of each language's value (1 where it has none)."""
        import numpy as np

        if not grams or not order:
            return np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32)
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        hashes = _hash(codes, np.arange(order - 1, len(codes), order), order)
        rows = np.log(np.array([[v.get(g, 1.0) for v in values] for g in grams])).astype(np.float32)
        at = np.argsort(hashes, kind="stable")
        return hashes[at], rows[at]

    @staticmethod
    def _find(hashes, table):
        import numpy as np

        if not len(table):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return at, table[at] == hashes

    def words(self, words: list[str]):
        """Log probability of each word (its end mark included) in each language."""
        import numpy as np

        codes, starts, ends = _codes(words)
        depth = np.arange(len(codes)) - np.repeat(starts, ends - starts)
        total = np.zeros((len(codes), len(self.langs)), np.float32)
        open_ = np.flatnonzero(depth > 0)
        for k in range(self.order, 0, -1):
            fits = depth[open_] >= k - 1
            at = open_[fits]
            hashes, rows, contexts, weights = self.tables[k - 1]
            where, hit = self._find(_hash(codes, at, k), hashes)
            total[at[hit]] += rows[where[hit]]
            missed = at[~hit]
            if k == 1:
                total[missed] += (self.back_empty + self.floor).astype(np.float32)
            elif len(missed):
                where, hit = self._find(_hash(codes, missed - 1, k - 1), contexts)
                total[missed[hit]] += weights[where[hit]]
            open_ = np.concatenate([open_[~fits], missed])
        return np.add.reduceat(total, starts, axis=0)

    def score(self, texts: list[str | None], cache: dict, most: int = 100_000):
        """(sums of log probabilities by language, characters, words) of every text; cache keeps rows by word."""
        import numpy as np

        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        for i, ws in enumerate(found):  # the pattern takes fractions and the like, too
            if ws and not any(w.isalpha() for w in ws) and not any(c.isalpha() for w in ws for c in w):
                found[i] = []
        if len(cache) > most:
            cache.clear()
        new = list(dict.fromkeys(w for ws in found for w in ws if w not in cache))
        table = cache.get("\x01rows")
        if table is None:
            table = cache["\x01rows"] = np.zeros((0, len(self.langs)), np.float64)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            cache.update(zip(part, range(len(table), len(table) + len(part))))
            table = np.concatenate([table, self.words(part)])
        cache["\x01rows"] = table
        get = cache.__getitem__
        sums, chars, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts))
        for i, ws in enumerate(found):
            if ws:
                at = np.fromiter(map(get, ws), np.int64, len(ws))
                sums[i] = table[at].sum(axis=0)
                chars[i] = sum(map(len, ws)) + len(ws)
                counts[i] = max(len(ws), chars[i] / 8)  # a long run of letters is more than one word
        return sums, chars, counts

    def calibrate(self, texts: list[str], z: float = 8.0) -> None:
        """Limits of rejection, from texts that are accepted."""
        import numpy as np

        sums, chars, counts = self.score(texts, {})
        some = chars > 0
        if not some.any():
            return
        best = -sums[some].max(axis=1) / chars[some]
        self.mean = float(best.mean())
        self.deviation = float(max(((best - self.mean) * np.sqrt(counts[some])).std(), 1e-3))
        worst = float(best.max())
        self.most = worst + max(0.0, self.uniform - worst) / 2
        self.z = z

    def predict(self, texts: list[str | None], cache: dict):
        """(lang, score, cross-entropy, accepted) of every text."""
        import numpy as np

        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        sums, chars, counts = self.score(texts, cache)
        some = chars > 0
        entropy = -sums / np.maximum(chars, 1)[:, None]
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        odds = np.exp(-(entropy - lowest[:, None]) * np.minimum(chars, 50)[:, None])
        score = np.where(some, 1 / odds.sum(axis=1), 0.0)
        limit = np.maximum(self.most, self.mean + self.z * self.deviation / np.sqrt(np.maximum(counts, 1)))
        langs = [self.langs[b] if s else "und" for b, s in zip(best, some)]
        return langs, score, lowest, some & (lowest <= limit)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, max_chars: int = 20_000, held: int = 2, folds: int = 4, order: int = ORDER, most_rows: int = 30_000) -> Models:
    """Models from at most per_lang rows of each language whose crc32(id) mod folds isn't held; no text is longer than max_chars.

    With so many languages that this would be more than some most_rows rows, each has an equal share of those.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars) & F.coalesce(crc_mod(id_col, folds) != held, F.lit(False)))
    ids = rows.select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_l")).distinct()
    counts = {r[0]: r[1] for r in ids.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_l").limit(MOST_LANGUAGES).collect()}
    pick = least_hashed(ids, "_l", min(per_lang, -(-most_rows // max(1, len(counts)))), counts)
    got = rows.select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t")).join(F.broadcast(pick), ["_i", "_l"]).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["_l"], r["_i"], r["_t"])):
        samples.setdefault(r["_l"], []).append(r["_t"])
    fit = {lang: [t for i, t in enumerate(ts) if i % 5 or len(ts) < 10] for lang, ts in samples.items()}
    models = Models(fit, order)
    models.calibrate([t for lang, ts in samples.items() for i, t in enumerate(ts) if not i % 5])
    return models


def _predict(models: Models, version: str):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache = worker_cache("langid", dict, version)
        for part in chunks(batches, "text", 1 << 20):
            langs, score, entropy, accepted = models.predict(part.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), pa.array(langs, pa.string()), pa.array(np.asarray(score, float)), pa.array(np.asarray(entropy, float)), pa.array(accepted)], names=[*part.schema.names, "lang_pred", "score", "cross_entropy", "accepted"])

    return run


def identify(rows: DataFrame, models: Models) -> DataFrame:
    """rows (column text, and any whose names aren't those that are added) with lang_pred, score, cross_entropy and accepted."""
    import uuid

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.transform(mapped, _predict(models, uuid.uuid4().hex), f"{schema}, lang_pred string, score double, cross_entropy double, accepted boolean")


def _accept(models: Models, version: str, column: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = worker_cache("langid", dict, version)
        for part in chunks(batches, column, 1 << 20):
            accepted = models.predict(part.column(column).to_pylist(), cache)[3]
            yield part.filter(pa.array(accepted))

    return run


def accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs without those that language identification rejects."""
    import uuid

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.transform(mapped, _accept(models, uuid.uuid4().hex, text_col), schema)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, train(docs)).drop("text")
