"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by id, and by a hash of address and payload within it, and cut into shards by bounds that are computed from exact byte
counts, so the same input gives the same bytes, whatever the session's settings, plans and partitions. Each record is a
gzip member of its own. A shard's file is closed when its compressed size reaches roll_bytes. Tasks write under temporary
names that hold their attempt; each gives a manifest row per file (name, records, bytes, SHA-256). The manifest of the
successful attempts is stored, then a second job renames exactly those files, skips what is renamed already, and
a manifest file is written last. The reader reads the files that the manifest names, and no others: an archive without a manifest
isn't complete, and what lost attempts or an earlier writer left under the same root is never read, and is removed at the end.

Of records with equal payloads the one with the smallest id is a response; the others are revisits that carry its
digest, its id and its HTTP header (with the full payload's length), but no payload.

Defined cases: null payloads are empty; a null id sorts last, is kept, and is a response only where its group has no other id;
repeated rows of a response's id are responses, too; an empty table gives an archive of no files; a root that holds an archive is
written anew; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, cut, is_small, join_skewed, mapped, shared_path

MANIFEST = "file string, temporary string, shard int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
EPOCH = "1970-01-01T00:00:00Z"
MOST_SHARDS = 1 << 16  # bounds are kept on the driver


def base32_of(hexdigest: str) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response, or a revisit if refers_to is given. digest: base32 SHA-1 of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    import base64
    import hashlib

    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {EPOCH}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        head.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shards:
    """The files of the shards that a task writes, one after the other."""

    def __init__(self, root: str, roll_bytes: int, level: int, attempt: int):
        from pyarrow import fs

        self.system, self.folder = fs.FileSystem.from_uri(root)
        self.roll_bytes, self.level, self.attempt = roll_bytes, level, attempt
        self.done: list[tuple] = []
        self.shard, self.serial, self.stream = None, 0, None

    def open(self) -> None:
        import hashlib

        self.name = f"part-{self.shard:06d}-{self.serial:06d}.warc.gz"
        self.temporary = f"tmp-{self.attempt}-{self.name}"
        self.serial += 1
        self.stream = self.system.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        info = b"software: tidelog\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, self.name)}\r\nWARC-Date: {EPOCH}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.put(head.encode() + info + b"\r\n\r\n")

    def put(self, data: bytes) -> None:
        packed = _member(data, self.level)
        self.stream.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.stream:
            self.stream.close()
            self.done.append((self.name, self.temporary, self.shard, self.records, self.bytes, self.sha.hexdigest()))
            self.stream = None

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.serial = shard, 0
        if self.stream is None:
            self.open()
        self.put(data)
        self.records += 1
        if self.bytes >= self.roll_bytes:
            self.close()


def _write(root: str, roll_bytes: int, level: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        files = _Shards(root, roll_bytes, level, context.taskAttemptId() if context else 0)
        for part in chunks(batches, "payload"):
            for r in part.to_pylist():
                files.add(r["shard"], record(r["page_id"], r["url"], r["payload"] or b"", base32_of(r["sha1"]), r["payload_bytes"], r["refers_to"]))
        files.close()
        columns = list(zip(*files.done)) if files.done else [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return run


def _commit(root: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                final, temporary = f"{folder}/{r['file']}", f"{folder}/{r['temporary']}"
                if system.get_file_info(temporary).type == fs.FileType.File:
                    if system.get_file_info(final).type == fs.FileType.File:  # of an earlier archive
                        system.delete_file(final)
                    system.move(temporary, final)
                if system.get_file_info(final).size != r["bytes"]:
                    raise OSError(f"{r['file']} isn't what its manifest says")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    return run


def place_of(width: int) -> Column:
    """The first id of an id's bucket; width: ids in it, a power of two."""
    return F.col("page_id").bitwiseAND(F.lit(-width).cast("long"))


def shard_bounds(rows: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """(page_id, hash) at which shards after the first start, ascending, from exact byte counts of rows (page_id, h, size).

    Ids are counted in up to 16 buckets a shard; buckets of over a shard are counted again in smaller ones, until each holds one
    id, and one id of over a shard is cut by its hash. There are at most MOST_SHARDS shards or so: they grow with a larger input.
    """
    ids = rows.where(F.col("page_id").isNotNull())
    low, high, total = ids.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if not total:
        return []
    most = max(shard_bytes, -(-total // MOST_SHARDS))
    shards = -(-total // most)
    width = 1 << max(0, ((high - low) // (16 * shards)).bit_length())
    found = ids.groupBy(place_of(width).alias("at")).agg(F.sum("size").alias("b")).collect()
    counts = [(r["at"], width, r["b"]) for r in found]  # first id, width in ids, bytes
    while heavy := [c for c in counts if c[2] > most and c[1] > 1]:
        width = heavy[0][1]
        finer = max(1, width // 16)
        inside = ids.withColumn("at", place_of(width))
        picked = rows.sparkSession.createDataFrame([(c[0],) for c in heavy], "at long")
        sub = inside.join(F.broadcast(picked), "at", "left_semi").drop("at").groupBy(place_of(finer).alias("at")).agg(F.sum("size").alias("b")).collect()
        gone = {c[0] for c in heavy}
        counts = [c for c in counts if c[0] not in gone or c[1] != width] + [(r["at"], finer, r["b"]) for r in sub]
    bounds, held = [], 0
    for at, _, size in sorted(counts):
        if held and held + size > most:
            bounds.append((at, -(1 << 63)))
            held = 0
        held += size
        if size > most:
            parts = -(-size // most)
            bounds += [(at, i * (1 << 64) // parts - (1 << 63)) for i in range(1, parts)]
            held = size // parts
    return bounds


def shard_of(bounds: list[tuple[int, int]]):
    """The number of bounds at or below (page_id, hash); null ids come after all."""

    @F.pandas_udf("int")
    def run(page_id: pd.Series, h: pd.Series) -> pd.Series:
        import numpy as np

        ids = np.array([b[0] for b in bounds], np.int64)
        hashes = np.array([b[1] for b in bounds], np.int64)
        null = page_id.isna().to_numpy()
        page = page_id.fillna(0).astype("int64").to_numpy()
        low, high = np.searchsorted(ids, page, "left"), np.searchsorted(ids, page, "right")
        shard, own = low.copy(), h.to_numpy()
        for i in np.flatnonzero(high > low):
            shard[i] += np.searchsorted(hashes[low[i] : high[i]], own[i], "right")
        return pd.Series(np.where(null, len(bounds), shard).astype(np.int32))

    return run


def write_archive(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = 256 << 20, least_bytes: int = 0, shard_bytes: int = 16 << 20, level: int = 6) -> str:
    """Writes pages as WARC files under root (a folder that all executors share; a new one by default) and gives root.

    Payloads of under least_bytes bytes are never revisits. A shard holds about shard_bytes, a record, of payloads.
    """
    spark = pages.sparkSession
    root = root or shared_path(spark, "warc")
    from pyarrow import fs

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    first = cut(first)
    rows = rows.join(F.broadcast(first.drop("n")), "sha1", "left") if is_small(first) else join_skewed(rows, first, "sha1", how="left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("payload", F.when(~again, F.col("payload"))).drop("first")
    rows = rows.withColumn("h", F.xxhash64("url", "sha1")).withColumn("size", F.coalesce(F.octet_length("payload"), F.lit(0)) + 512)
    bounds = shard_bounds(rows.select("page_id", "h", "size"), shard_bytes)
    shard = shard_of(bounds)(F.col("page_id"), F.col("h")) if bounds else F.lit(0)
    rows = rows.withColumn("shard", shard).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "h", "url", "sha1")
    system, folder = fs.FileSystem.from_uri(root)
    system.create_dir(folder, recursive=True)
    if system.get_file_info(f"{folder}/manifest").type == fs.FileType.Directory:  # from here on the root holds no complete archive
        system.delete_dir(f"{folder}/manifest")
    manifest = cut(rows.transform(mapped, _write(root, roll_bytes, level), MANIFEST))
    manifest.transform(mapped, _commit(root), "file string").write.format("noop").mode("overwrite").save()
    _remove_leftovers(manifest, system, folder)
    manifest.drop("temporary").orderBy("file").coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return root


def _remove_leftovers(manifest: DataFrame, system, folder: str) -> None:
    """Removes files that the manifest doesn't name: those of lost attempts, and of an earlier archive."""
    from pyarrow import fs

    kept = {r["file"] for r in manifest.select("file").toLocalIterator()}
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.File and info.base_name.endswith(".warc.gz") and info.base_name not in kept:
            system.delete_file(info.path)


def parse(read: Callable[[int], bytes], size: int = 1 << 16) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record in a WARC file of gzip members, read piece by piece; header names in lower case."""
    data = read(size)
    while data:
        unpacker = zlib.decompressobj(31)
        parts = []
        while not unpacker.eof:
            if not data:
                raise ValueError("the archive is cut off")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data if unpacker.eof else read(size)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, rest[: int(headers["content-length"])]
        data = data or read(size)


def _read(root: str, with_payload: bool):
    def run(batches: Iterator) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        rows, held = [], 0

        def flush():
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def of_file(name: str, size: int, sha256: str) -> Iterator:
            seen, sha = 0, hashlib.sha256()

            def read(n: int) -> bytes:
                nonlocal seen
                data = stream.read(n)
                seen += len(data)
                sha.update(data)
                return data

            with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                yield from parse(read)
            if (seen, sha.hexdigest()) != (size, sha256):
                raise ValueError(f"{name} isn't what its manifest says")

        for batch in batches:
            for file in batch.to_pylist():
                for headers, block in of_file(file["file"], file["bytes"], file["sha256"]):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        length = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError("a payload doesn't match its digest")
                    else:
                        length, payload = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), None
                    page, target = headers.get("x-page"), headers.get("x-refers-to-page")
                    rows.append((page and int(page), headers.get("warc-target-uri"), kind, length, digest, target and int(target), payload if with_payload else None))
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) >= 5000 or held >= 8 << 20:
                        yield flush()
                        held = 0
        yield flush()

    return run


def read_archive(spark, root: str, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of a complete archive; files, lengths and payload digests are checked. A file is a task's unit of work."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(root)
    if system.get_file_info(f"{folder}/manifest/_SUCCESS").type != fs.FileType.File:
        raise FileNotFoundError(f"{root} holds no complete archive")
    files = spark.read.schema("file string, shard int, records long, bytes long, sha256 string").json(f"{root}/manifest")
    n = files.count()
    return files.repartition(max(1, min(n, 1 << 16))).transform(mapped, _read(root, with_payload), RECORDS) if n else spark.createDataFrame([], RECORDS)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    root = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
