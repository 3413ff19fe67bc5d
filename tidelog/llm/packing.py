"""Harmonic packing of token sequences.

Every document is its token ids and an end id. It is cut into full sequences of `capacity` ids and a rest; the rest is cut
at capacity/2, capacity/4, ... down to `least`, and what is left (under `least` ids) stays whole. A piece of length n
belongs to the reciprocal-capacity class k = capacity // n, whose bins take exactly k pieces: for the powers of two they
fill a bin without padding, and below `least` each class has one length only, so that a bin lacks under `least` ids.

Classes are filled independently in every partition, so nothing is shuffled and a lost task repeats itself exactly. Only the
pieces of open bins are held (under capacity pieces a class). At the end of a partition the pieces in open bins are put one
after the other, cut where a bin is full, and the last bin is cut at powers of two, whose sequences need no padding.

Defined cases: null text is empty (the end id alone); repeated rows are packed each; an empty table gives an empty result;
null ids stay null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, mapped, worker_cache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE files write a byte as a letter: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """A byte-level BPE file's tokens as bytes with their ids, if the ids are the order of the merges and nothing but the usual
    splitting at words is done before them; else None."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        return None
    vocabulary, letters = model["vocab"], _byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocabulary.get(a + b) for a, b in pairs]
    singles = [vocabulary.get(c) for c in letters]
    if None in ids or None in singles or ids != sorted(set(ids)) or max(singles) > min(ids):
        return None
    return {bytes(letters[c] for c in token): vocabulary[token] for token in [*letters, *(a + b for a, b in pairs)]}


def added_tokens(path: str) -> list[str]:
    """The strings that a tokenizer file gives ids of their own, before it looks at anything else."""
    import json

    with open(path, encoding="utf-8") as file:
        return sorted(t["content"] for t in json.load(file).get("added_tokens") or [] if t["content"])


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, for byte-level BPE whose words begin at a space.

    Such a tokenizer never joins characters across a space that follows a character which isn't white space and precedes
    one which isn't: a text without white space after a space, and without a space at its end, is the concatenation of
    its space-led words. Their ids are kept by word (a cache of at most `most` words, emptied when full). New words are encoded
    together by the same merges in one string, and cut where words end. Any other text goes through the tokenizer whole: one that
    holds an added token's string ("<|endoftext|>"), which is that token's id, and every text of a file that ranks_of() doesn't read.
    """

    # The fixed pattern of this kind of byte-level BPE.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, most: int = 150_000):
        import os
        import re

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = added_tokens(path)
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.most = most
        self.known: dict[str, bytes] = {}
        self.spaced = re.compile(r" \s").search
        self.merges = None
        if ranks := ranks_of(path):
            import tiktoken

            self.merges = tiktoken.Encoding("merges", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.sizes[i] = len(token)

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def together(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it."""
        import numpy as np

        if not words:
            return []
        ids = np.array(self.merges.encode_ordinary(" " + " ".join(words)), dtype="<u4")
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        at = np.searchsorted(ends, wanted)
        if at[-1] >= len(ends) or (ends[at] != wanted).any():
            return self.whole([" " + w for w in words])
        raw, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text. Words that aren't known yet are encoded together."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        apart = lambda t: t and t[0] != " " and t[-1] != " " and not self.spaced(t) and not self.added(t)
        words = [t.split(" ") if self.merges is not None and apart(t) else None for t in texts]
        new = list({w for ws in words if ws for w in ws[1:] if w not in known})
        known.update(zip(new, self.together(new)))
        firsts = iter(self.whole([ws[0] if ws else t for ws, t in zip(words, texts)]))
        get = known.__getitem__
        return [b"".join((first, *map(get, ws[1:]))) if ws else first for ws, first in zip(words, firsts)]


def _pack(path: str, capacity: int, least: int, end: bytes):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encoder = worker_cache("encoder", lambda: Encoder(path), path)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        open_bins: dict[int, list] = {}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        def put(piece, sequence: int, offset: int) -> None:
            doc, start, ids, total = piece
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

        for part in chunks(batches, "text", 1 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += end
                total, at, size = len(ids) // 4, 0, capacity
                while at < total:
                    while size > total - at and size > least:
                        size //= 2
                    n = min(size, total - at)
                    piece = (doc, at, ids[4 * at : 4 * (at + n)], total)
                    at += n
                    if n == capacity:
                        put(piece, serial, 0)
                        serial += 1
                        continue
                    k = capacity // n
                    held = open_bins.setdefault(k, [])
                    held.append(piece)
                    if len(held) == k:
                        offset = 0
                        for x in held:
                            put(x, serial, offset)
                            offset += len(x[2]) // 4
                        serial += 1
                        held.clear()
                if len(rows) > 20_000:
                    yield flush()
        left = sum(len(x[2]) // 4 for k in open_bins for x in open_bins[k])
        room, offset = min(capacity, 1 << (left.bit_length() - 1)) if left else 0, 0
        for k in sorted(open_bins):
            for doc, start, ids, total in open_bins[k]:
                while ids:
                    n = min(len(ids) // 4, room - offset)
                    put((doc, start, ids[: 4 * n], total), serial, offset)
                    start, ids, offset, left = start + n, ids[4 * n :], offset + n, left - n
                    if offset == room and left:
                        serial, offset, room = serial + 1, 0, min(capacity, 1 << (left.bit_length() - 1))
        yield flush()

    return run


def harmonic_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, least: int = 16, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece; capacity and least are powers of two. sequence_id holds the partition's number in its upper bits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run = _pack(tokenizer or default_tokenizer(), capacity, least, end_id.to_bytes(4, "little"))
    return rows.transform(mapped, run, SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024 tokens."""
    return harmonic_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
