"""64-bit hashes that SQL functions lack, vectorised over Arrow batches; public algorithms from their published definitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a's offset basis and prime, splitmix64's multipliers, the golden ratio, jump hash's multiplier.
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x00000100000001B3
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
GOLDEN = 0x9E3779B97F4A7C15
JUMP = 2862933555777941757
CRC64_XZ = 0xC96C5795D7870F42


def _bytewise(values: list[bytes], start: int, step):
    """step(states, byte) over the bytes of all values, a place of all of them at a time; the longest come first, so that those still
    running are a prefix, and no more is held than the values themselves."""
    import numpy as np

    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    every = np.frombuffer(b"".join(values), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    state = np.full(len(values), start, np.uint64)
    ends = np.sort(sizes)
    for at in range(int(sizes.max(initial=0))):
        n = len(sizes) - int(np.searchsorted(ends, at, "right"))
        state[:n] = step(state[:n], every[starts[:n] + at].astype(np.uint64))
    out = np.empty_like(state)
    out[order] = state
    return out


def fnv1a(values: list[bytes], separators: bool = False):
    """FNV-1a of each value. With separators, 0xFF ends a field: fields are split at NUL."""
    import numpy as np

    def step(h, byte):
        return (h ^ (np.where(byte == 0, np.uint64(0xFF), byte) if separators else byte)) * np.uint64(FNV_PRIME)

    return _bytewise(values, FNV_BASIS, step)


def finalize(h):
    """splitmix64's finalizer."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def _keys(key: pd.Series) -> list[bytes]:
    return [b"" if k is None else k.encode() for k in key]


def shard_modulo(key: Column, shards: int) -> Column:
    """The shard of a key: finalized FNV-1a modulo shards; 0 without a key."""

    @F.pandas_udf("int")
    def run(key: pd.Series) -> pd.Series:
        import numpy as np

        got = (finalize(fnv1a(_keys(key))) % np.uint64(shards)).astype(np.int32)
        return pd.Series(np.where(key.isna(), 0, got))

    return F.lit(0) if shards <= 1 else run(key)


def shard_jump(key: Column, shards: int) -> Column:
    """The shard of a key by jump consistent hash; 0 without a key."""

    @F.pandas_udf("int")
    def run(key: pd.Series) -> pd.Series:
        import numpy as np

        state = finalize(fnv1a(_keys(key)))
        bucket, following = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        while (on := following < shards).any():
            bucket = np.where(on, following, bucket)
            state = np.where(on, state * np.uint64(JUMP) + np.uint64(1), state)
            step = (bucket + 1).astype(float) * (float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(float))
            following = np.where(on, step.astype(np.int64), following)
        return pd.Series(np.where(key.isna(), 0, bucket).astype(np.int32))

    return F.lit(0) if shards <= 1 else run(key)


def shard_hashes(tenant: list[str], namespace: list[str], stream: list[str], shard: list[int]):
    """The hash of each shard's name, one side of its scores."""
    import numpy as np

    number = np.array(shard, np.int64).astype(np.uint64)
    h = fnv1a([b"%s\0%s\0%s\0" % (t.encode(), n.encode(), s.encode()) for t, n, s in zip(tenant, namespace, stream)], separators=True)
    for back in (24, 16, 8, 0):  # the shard's four bytes may be zero, so they are folded apart
        h = (h ^ ((number >> np.uint64(back)) & np.uint64(0xFF))) * np.uint64(FNV_PRIME)
    return finalize((h ^ np.uint64(0xFF)) * np.uint64(FNV_PRIME))


def node_hashes(node: list[str]):
    """The hash of each node's name, the other side of its scores."""
    import numpy as np

    h = finalize(fnv1a([n.encode() + b"\0" for n in node], separators=True))
    return (h << np.uint64(32)) | (h >> np.uint64(32))


def rendezvous_scores(shard, nodes):
    """The scores of nodes for a shard (a hash of shard_hashes, and those of node_hashes), unsigned."""
    import numpy as np

    return finalize((shard * np.uint64(GOLDEN)) ^ nodes)


def crc64_table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CRC64_XZ if byte & 1 else 0)
        table.append(byte)
    return table


def crc64(data: bytes, table: list[int] | None = None) -> int:
    """CRC-64/XZ."""
    table = table or crc64_table()
    crc = (1 << 64) - 1
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ ((1 << 64) - 1)


def crc64_all(payloads: list[bytes]):
    """CRC-64/XZ of every payload."""
    import numpy as np

    table = np.array(crc64_table(), np.uint64)
    step = lambda crc, byte: table[((crc ^ byte) & np.uint64(0xFF)).astype(np.int64)] ^ (crc >> np.uint64(8))
    return ~_bytewise(payloads, (1 << 64) - 1, step)


def _raw(payloads) -> list[bytes]:
    return [b"" if p is None else p.encode() if isinstance(p, str) else bytes(p) for p in payloads]


def record_digests(payloads: list[bytes]):
    """CRC-64/XZ of each payload's length (8 bytes, big-endian) and bytes."""
    return crc64_all([len(r).to_bytes(8, "big") + r for r in payloads])


def record_digest(payload: Column) -> Column:
    """The digest of a record, as a signed number."""

    @F.pandas_udf("long")
    def run(payload: pd.Series) -> pd.Series:
        return pd.Series(record_digests(_raw(payload)).view("int64"))

    return run(payload)


def batch_digests(batches: list[list[bytes]]):
    """The digest of each batch: from 0 on, the CRC-64/XZ of the digest so far and the next record's, both 8 bytes, big-endian."""
    import numpy as np

    sizes = np.fromiter((len(b) for b in batches), np.int64, len(batches))
    records = record_digests([r for b in batches for r in b])
    starts = np.cumsum(sizes) - sizes
    state = np.zeros(len(batches), np.uint64)
    for at in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > at)
        pairs = np.stack([state[on], records[starts[on] + at]], axis=1).astype(">u8")
        state[on] = crc64_all([p.tobytes() for p in pairs])
    return state


def batch_digest(payloads: Column) -> Column:
    """The digest of a batch, an array of payloads in their order, as a signed number; 0 for an empty one."""

    @F.pandas_udf("long")
    def run(payloads: pd.Series) -> pd.Series:
        return pd.Series(batch_digests([[] if p is None else _raw(p) for p in payloads]).view("int64"))

    return run(payloads)
