"""Binary and text forms of records, from their published layouts: header blocks, commit records, record batches (magic 2), page cursors.

All numbers are big-endian. Decoders check every length, and raise ValueError on bytes that aren't what they should be.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASTAGNOLI = 0x82F63B78
COMMIT_VERSION, PUT, DELETE = 1, 0, 1


class _Reader:
    """Fields one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the bytes end within a field")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(f">{form}", self.take(struct.calcsize(f">{form}")))[0]

    def sized(self, form: str = "I") -> bytes:
        return self.take(self.number(form))

    def varint(self) -> int:
        """A zigzag number of seven bits a byte."""
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value >> 1 ^ -(value & 1)
            if shift > 63:
                raise ValueError("a number is too long")

    def end(self) -> None:
        if self.at != len(self.data):
            raise ValueError("bytes are left over")


def encode_headers(key: bytes | None, headers: list[tuple[str, bytes]]) -> bytes:
    """A record's key and headers as a block; b"" for neither."""
    if key is None and not headers:
        return b""
    out = [struct.pack(">B", key is not None)]
    if key is not None:
        out += [struct.pack(">I", len(key)), key]
    out.append(struct.pack(">I", len(headers)))
    for name, value in headers:
        raw = name.encode()
        if not raw:
            raise ValueError("a header has no name")
        out += [struct.pack(">H", len(raw)), raw, struct.pack(">I", len(value)), value]
    return b"".join(out)


def decode_headers(data: bytes) -> tuple[bytes | None, list[tuple[str, bytes]]]:
    if not data:
        return None, []
    r = _Reader(data)
    flags = r.number("B")
    if flags > 1:
        raise ValueError("unknown flags")
    key = r.sized() if flags else None
    headers = []
    for _ in range(r.number("I")):
        name = r.sized("H")
        if not name:
            raise ValueError("a header has no name")
        headers.append((name.decode(), r.sized()))
    r.end()
    if key is None and not headers:
        raise ValueError("an empty block")
    return key, headers


def encode_commit(event: bytes, ops: list[tuple[str, str, bytes | None]]) -> bytes:
    """A commit's event and operations: (put or delete, key, value)."""
    out = [struct.pack(">BI", COMMIT_VERSION, len(event)), event, struct.pack(">I", len(ops))]
    for kind, key, value in ops:
        raw = key.encode()
        out += [struct.pack(">BI", PUT if kind == "put" else DELETE, len(raw)), raw]
        if kind == "put":
            out += [struct.pack(">I", len(value)), value]
    return b"".join(out)


def decode_commit(data: bytes) -> tuple[bytes, list[tuple[str, str, bytes | None]]]:
    r = _Reader(data)
    if r.number("B") != COMMIT_VERSION:
        raise ValueError("unknown version")
    event, ops = r.sized(), []
    for _ in range(r.number("I")):
        kind = r.number("B")
        if kind not in (PUT, DELETE):
            raise ValueError("unknown operation")
        key = r.sized().decode()
        ops.append(("put", key, r.sized()) if kind == PUT else ("delete", key, None))
    r.end()
    return event, ops


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC32C[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def _table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CASTAGNOLI if byte & 1 else 0)
        table.append(byte)
    return table


_CRC32C = _table()


def _varint(value: int) -> bytes:
    value, out = (value << 1) ^ (value >> 63), bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _sized(value: bytes | None) -> bytes:
    return _varint(-1) if value is None else _varint(len(value)) + value


def encode_batch(base: int, records: list[tuple[int, int, bytes | None, bytes | None, list[tuple[str, bytes]]]], last: int | None = None, producer: tuple[int, int, int] = (-1, -1, -1)) -> bytes:
    """A batch of records (offset, milliseconds, key, value, headers) from offset base to last; with no records it covers offsets that hold none."""
    times = [r[1] for r in records] or [-1]
    last = records[-1][0] if last is None else last
    body = [struct.pack(">hiqqqhii", 0, last - base, times[0], max(times), *producer, len(records))]
    for offset, ms, key, value, headers in records:
        one = b"\0" + _varint(ms - times[0]) + _varint(offset - base) + _sized(key) + _sized(value) + _varint(len(headers))
        one += b"".join(_sized(n.encode()) + _sized(v) for n, v in headers)
        body += [_varint(len(one)), one]
    raw = b"".join(body)
    return struct.pack(">qiibI", base, 9 + len(raw), 0, 2, crc32c(raw)) + raw


def decode_batches(data: bytes) -> Iterator[dict]:
    """The batches in some bytes: base, last, producer (id, epoch, sequence) and records (offset, milliseconds, key, value, headers)."""
    r = _Reader(data)
    while r.at < len(data):
        base, body = r.number("q"), _Reader(r.sized("i"))
        body.number("i")
        if body.number("b") != 2:
            raise ValueError("unknown magic")
        if crc32c(body.data[9:]) != body.number("I"):
            raise ValueError("a batch doesn't match its checksum")
        if body.number("h") & 7:
            raise ValueError("a compressed batch")
        last, first, _ = base + body.number("i"), body.number("q"), body.number("q")
        producer, records = (body.number("q"), body.number("h"), body.number("i")), []
        for _ in range(body.number("i")):
            one = _Reader(body.take(body.varint()))
            one.take(1)
            ms, offset = first + one.varint(), base + one.varint()
            field = lambda: None if (n := one.varint()) < 0 else one.take(n)  # noqa: B023, E731
            key, value = field(), field()
            headers = [((field() or b"").decode(), field()) for _ in range(one.varint())]
            one.end()
            records.append((offset, ms, key, value, headers))
        body.end()
        yield {"base": base, "last": last, "producer": producer, "records": records}


BATCH = "stream string, shard int, base long, last long, data binary"
PRODUCED = "stream string, shard int, offset long, ts_ms long, key string, payload string, producer_id long, sequence long"


def _encoded(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = batch.to_pylist()
        data = [encode_batch(r["base"], [(x["offset"], x["ts_ms"], x["key"].encode(), x["payload"].encode(), []) for x in r["records"]], r["last"]) for r in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("stream", "shard", "base", "last")), pa.array(data, pa.binary())], names=["stream", "shard", "base", "last", "data"])


def record_batches(log: DataFrame, size: int = 100) -> DataFrame:
    """A log's data records as batches of up to `size` offsets each. What control records there are at the end of a run of offsets is covered by the
    batch's last offset, so that a reader moves past them."""
    run = F.floor(F.col("offset") / size).cast("long").alias("run")
    record = F.when(F.col("mark_kind") == "data", F.struct("offset", F.floor(F.col("ts_us") / 1000).cast("long").alias("ts_ms"), "key", "payload"))
    t = log.groupBy("stream", "shard", run).agg(F.min("offset").alias("base"), F.max("offset").alias("last"), F.sort_array(F.collect_list(record)).alias("records"))
    return t.drop("run").mapInArrow(_encoded, BATCH)


def _decoded(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [c.split()[0] for c in PRODUCED.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for b in decode_batches(r["data"]):
                producer, _, sequence = b["producer"]
                for n, (offset, ms, key, value, _) in enumerate(b["records"]):
                    out.append((r["stream"], r["shard"], offset, ms, key and key.decode(), value and value.decode(), producer, sequence + n if sequence >= 0 else -1))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)


def produced(batches: DataFrame) -> DataFrame:
    """The records in batches that were produced (stream, shard, data)."""
    return batches.mapInArrow(_decoded, PRODUCED)


def _counted(values):
    """Each of some binary values after its length, four bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(_big(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)), values, pa.scalar(b"", pa.binary()))


def _big(numbers):
    """Numbers as four bytes each."""
    import pyarrow as pa

    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), len(numbers), [None, pa.py_buffer(numbers.astype(">u4").tobytes())]).cast(pa.binary())


def encode_commits(events, ops):
    """encode_commit for a batch: an Arrow array of events, and one of lists of operations (op, key, value), whose values are numbers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    flat, empty = ops.flatten(), pa.scalar(b"", pa.binary())
    puts = pc.equal(flat.field("op"), "put")
    kind = pc.if_else(puts, pa.scalar(bytes([PUT]), pa.binary()), pa.scalar(bytes([DELETE]), pa.binary()))
    value = _counted(pc.cast(pc.cast(pc.if_else(puts, flat.field("value"), 0), pa.string()), pa.binary()))
    each = pc.binary_join_element_wise(kind, _counted(pc.cast(flat.field("key"), pa.binary())), pc.if_else(puts, value, empty), empty)
    sizes = pc.list_value_length(ops).to_numpy(zero_copy_only=False).astype(np.int64)
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each), empty)
    return pc.binary_join_element_wise(pa.scalar(bytes([COMMIT_VERSION]), pa.binary()), _counted(pc.cast(events, pa.binary())), _big(sizes), body, empty)


def _taken(data, starts, sizes):
    """The pieces of some bytes, as an Arrow array."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())])


def decode_commits(records):
    """decode_commit for a batch (an Arrow array): the events, and of all operations the record's and its own number, whether it is a put, its key
    and its value (empty for a delete), in order. The n-th operations of all records are read in one step."""
    import numpy as np
    import pyarrow as pa

    records = records.cast(pa.large_binary())
    bounds = np.frombuffer(records.buffers()[1], np.int64)[records.offset : records.offset + len(records) + 1]
    data = np.frombuffer(records.buffers()[2], np.uint8) if len(records) and records.buffers()[2] else np.zeros(0, np.uint8)
    at, end = bounds[:-1].copy(), bounds[1:]

    def take(rows, n):
        found = at[rows].copy()
        at[rows] += n
        if (at[rows] > end[rows]).any():
            raise ValueError("the bytes end within a field")
        return found

    def number(rows):
        return data[take(rows, 4)[:, None] + np.arange(4)].astype(np.int64) @ (1 << np.array([24, 16, 8, 0]))

    def sized(rows):
        n = number(rows)
        return take(rows, n), n

    every = np.arange(len(records))
    if (data[take(every, 1)] != COMMIT_VERSION).any():
        raise ValueError("unknown version")
    events = _taken(data, *sized(every))
    counts, found, n = number(every), [], 0
    while len(rows := np.flatnonzero(counts > n)):
        kind = data[take(rows, 1)]
        if ((kind != PUT) & (kind != DELETE)).any():
            raise ValueError("unknown operation")
        key, put = sized(rows), kind == PUT
        value = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        value[0][put], value[1][put] = sized(rows[put])
        found.append((rows, np.full(len(rows), n), put, *key, *value))
        n += 1
    if (at != end).any():
        raise ValueError("bytes are left over")
    rows, place, put, *pieces = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64) for _ in range(7))
    order = np.lexsort((place, rows))
    pieces = [p[order] for p in pieces]
    return events, rows[order], place[order], put[order].astype(bool), _taken(data, *pieces[:2]), _taken(data, *pieces[2:])


def _commit_bytes(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("offset"), encode_commits(batch.column("event"), batch.column("ops"))], names=["shard", "offset", "data"])


def commit_records(commits: DataFrame, ops: DataFrame) -> DataFrame:
    """Commits as the records that the log holds: shard, offset, data. Only a commit's own operations are gathered."""
    own = ops.groupBy("shard", "offset").agg(F.sort_array(F.collect_list(F.struct("place", "op", "key", "value"))).alias("ops"))
    own = own.withColumn("ops", F.transform("ops", lambda o: F.struct(o["op"].alias("op"), o["key"].alias("key"), o["value"].alias("value"))))
    rows = commits.join(own, ["shard", "offset"], "left").withColumn("ops", F.coalesce("ops", F.array().cast(own.schema["ops"].dataType)))
    return rows.select("shard", "offset", "event", "ops").mapInArrow(_commit_bytes, "shard int, offset long, data binary")


def _commit_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    text = lambda c: c.cast(pa.large_string()).cast(pa.string())
    for batch in batches:
        events, of, place, put, key, value = decode_commits(batch.column("data"))
        of, put = pa.array(of), pa.array(put)
        number = pc.if_else(put, text(value), pa.scalar(None, pa.string())).cast(pa.int64())
        own = [batch.column("shard").take(of), batch.column("offset").take(of), text(events).take(of)]
        op = pc.if_else(put, "put", "delete")
        yield pa.RecordBatch.from_arrays([*own, pa.array(place, pa.int32()), op, text(key), number], names=["shard", "offset", "event", "place", "op", "key", "value"])


def commit_operations(records: DataFrame) -> DataFrame:
    """The operations in commit records, a row each; place numbers them within their commit."""
    return records.mapInArrow(_commit_rows, "shard int, offset long, event string, place int, op string, key string, value long")


def encode_cursor(key: list) -> str:
    """A page cursor: the last key as URL-safe base64 of JSON, without padding."""
    return base64.urlsafe_b64encode(json.dumps(key, separators=(",", ":")).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, fields: int) -> list:
    try:
        key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as fault:
        raise ValueError("not a cursor of this listing") from fault
    if not isinstance(key, list) or len(key) != fields:
        raise ValueError("not a cursor of this listing")
    return key
