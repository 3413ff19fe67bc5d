"""Media columns: baseline JPEG, written and read with numpy.

`encode` stores bytes losslessly as the quantised coefficients of a baseline JPEG (the format's unit): a byte is a coefficient
of size category 8, whose 8 amplitude bits are the byte itself, so 192 bytes are one MCU of three blocks of 64.
Every MCU is a restart interval. The image is a grid of MCUs; a comment holds the number of MCUs that carry bytes.

`decode` reads any baseline scan with restart markers or without: markers are parsed, Huffman tables built, and the restart
intervals of all images of a batch that share tables and sampling are decoded in step, a symbol of each at a
time. DC coefficients alone give the luminance thumbnail, an eighth of the image's size.

Defined cases: null text is empty; an empty text is stored as one MCU of blanks; repeated rows and equal texts give equal
values; an empty table gives an empty result; other columns are not read. Images other than baseline, and
damaged ones, raise ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, mapped

UNIT = 192
SLICE = 1 << 13
_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def _huffman(kind: int, slot: int, codes: dict[int, list[int]]) -> bytes:
    """A DHT segment; codes: symbols by code length."""
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes(len(codes.get(n, ())) for n in range(1, 17)) + bytes(s for n in sorted(codes) for s in codes[n]))


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of MCUs, as square as whole rows allow."""
    columns = 1
    while columns * columns < units:
        columns += 1
    return columns, -(-units // columns)


def _filler() -> bytes:
    return bytes((0b10101010, 0b10101111))


def encode(payload: bytes) -> bytes:
    """A JPEG file that holds payload, whose length is a positive multiple of 192."""
    import numpy as np

    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload's length must be a positive multiple of 192")
    columns, rows = grid(units)
    if columns > 8191:
        raise ValueError("the payload is too long for one image")
    out = [
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xFE, f"units={units}".encode()),
        _segment(0xDB, b"\0" + bytes([4] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + bytes((1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0))),
        _huffman(0, 0, {1: [8], 2: [0]}),
        _huffman(1, 0, {1: [0x08], 2: [0x00]}),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))),
    ]
    for at in range(0, units, SLICE):
        part = np.frombuffer(payload, np.uint8, min(SLICE, units - at) * UNIT, at * UNIT).reshape(-1, UNIT)
        bits = np.zeros((len(part), UNIT, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(part, axis=1).reshape(len(part), UNIT, 8)
        coded = np.empty((len(part), UNIT * 9 // 8 + 2), np.uint8)
        coded[:, :-2] = np.packbits(bits.reshape(len(part), -1), axis=1)
        coded[:, -2] = 0xFF
        coded[:, -1] = 0xD0 + (at + np.arange(len(part))) % 8
        stuffed = coded == 0xFF
        stuffed[:, -2:] = False
        flat, extra = coded.reshape(-1), stuffed.reshape(-1)
        times = 1 + extra
        whole = np.repeat(flat, times)
        whole[np.cumsum(times)[extra] - 1] = 0
        out.append(whole.tobytes())
    if columns * rows > units:
        out += [_filler() + bytes((0xFF, 0xD0 + i % 8)) for i in range(units, columns * rows)]
    out[-1] = out[-1][:-2]
    out.append(b"\xff\xd9")
    return b"".join(out)


def _lookup(lengths: bytes, symbols: bytes):
    """For every 16-bit prefix the symbol and its code's length; length 0 where no code fits."""
    import numpy as np

    table = np.zeros(1 << 16, np.uint16)
    code = at = 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            first = code << (16 - n)
            table[first : first + (1 << (16 - n))] = symbols[at] << 8 | n
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse(data: bytes) -> dict:
    """Header fields of a baseline JPEG, its tables (raw) and its entropy-coded scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, found = 2, {"quant": {}, "huffman": {}, "restart": 0, "comments": []}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("damaged JPEG header")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            found |= {"width": width, "height": height, "parts": tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n))}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG is supported")
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                found["quant"][body[i] & 15] = struct.unpack_from(">64H", body, i + 1) if wide else tuple(body[i + 1 : i + 65])
                i += 1 + (128 if wide else 64)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                found["huffman"][body[i]] = (body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDD:
            (found["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            found["comments"].append(body)
        elif marker == 0xDA:
            if "parts" not in found or body[0] != len(found["parts"]):
                raise ValueError("only one interleaved scan is supported")
            found["tables"] = tuple((body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            end = _END.search(data, at)
            found["scan"] = data[at : end.start() if end else len(data)]
            return found


def _shape(image: dict) -> tuple[int, int]:
    """MCU columns and rows."""
    across, down = max(p[1] for p in image["parts"]), max(p[2] for p in image["parts"])
    return -(-image["width"] // (8 * across)), -(-image["height"] // (8 * down))


def _blocks(image: dict) -> list[tuple[int, int, int]]:
    """(component, DC table, AC table) of each block of an MCU."""
    return [(c, *image["tables"][c]) for c, p in enumerate(image["parts"]) for _ in range(p[1] * p[2])]


def _intervals(scan: bytes):
    """The scan without stuffing and restart markers, and where each restart interval starts and ends in it."""
    import numpy as np

    raw = np.frombuffer(scan, np.uint8)
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    after = raw[mark + 1] if len(mark) else np.zeros(0, np.uint8)
    restarts = mark[after != 0]
    keep = np.ones(len(raw), bool)
    keep[mark[after == 0] + 1] = False
    keep[restarts] = False
    keep[restarts + 1] = False
    kept = np.cumsum(keep)
    cuts = kept[restarts]
    return raw[keep], np.concatenate([[0], cuts]), np.concatenate([cuts, [int(keep.sum())]])


class _Bits:
    """Bit readers that go through one buffer in step."""

    def __init__(self, buffer, starts):
        import numpy as np

        whole = len(buffer) // 8 + 2
        padded = np.concatenate([buffer, np.zeros(8 * whole + 8 - len(buffer), np.uint8)])
        self.words = np.empty(8 * whole, np.uint64)
        for i in range(8):
            self.words[i::8] = padded[i : i + 8 * whole].view(">u8")
        self.at = starts.astype(np.int64) * 8

    def symbol(self, table, lanes):
        """The next symbol of the lanes, and the value of the amplitude bits that its low four bits count; a symbol that all lanes share comes as one int."""
        import numpy as np

        at = self.at if lanes is None else self.at[lanes]
        word = self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).view(np.uint64)
        entry = table[(word >> np.uint64(48)).view(np.int64)]
        if entry[0] and (entry == entry[0]).all():
            size, symbol = int(entry[0]) & 255, int(entry[0]) >> 8
            n = symbol & 15
            if n:
                bits = ((word << np.uint64(size)) >> np.uint64(64 - n)).view(np.int64)
                value = bits - ((bits < 1 << (n - 1)) * ((1 << n) - 1))
            else:
                value = np.zeros(len(at), np.int64)
            at = at + (size + n)
        else:
            size = (entry & 255).astype(np.uint64)
            if not size.all():
                raise ValueError("damaged JPEG scan")
            symbol = (entry >> 8).astype(np.int64)
            n = symbol & 15
            bits = ((word << size) >> np.uint64(1) >> (63 - n).astype(np.uint64)).view(np.int64)
            value = np.where((n > 0) & (bits < (np.int64(1) << np.maximum(n - 1, 0))), bits - (np.int64(1) << n) + 1, bits)
            at = at + size.astype(np.int64) + n
        if lanes is None:
            self.at = at
        else:
            self.at[lanes] = at
        return symbol, value


def _decode_lanes(buffer, starts, units, blocks, dc, ac):
    """Coefficients [lane, unit, block, 64] of intervals of at most max(units) MCUs; lanes with fewer end early."""
    import numpy as np

    most = int(units.max())
    out = np.zeros((most, len(blocks), 64, len(starts)), np.int16)
    reader = _Bits(buffer, starts)
    last = np.zeros((max(b[0] for b in blocks) + 1, len(starts)), np.int64)
    for u in range(most):
        lanes = None if (units > u).all() else np.flatnonzero(units > u)
        rows = np.arange(len(starts)) if lanes is None else lanes
        for b, (part, dc_table, ac_table) in enumerate(blocks):
            _, value = reader.symbol(dc[dc_table], lanes)
            last[part, rows] += value
            out[u, b, 0, rows] = last[part, rows]
            alive, k, one = rows, 1, True  # one: k is the same in all lanes
            while len(alive):
                symbol, value = reader.symbol(ac[ac_table], None if len(alive) == len(starts) else alive)
                if one and isinstance(symbol, int):
                    k += symbol >> 4
                    if symbol & 15:
                        if k > 63:
                            raise ValueError("damaged JPEG scan")
                        if len(alive) == len(starts):
                            out[u, b, k] = value
                        else:
                            out[u, b, k, alive] = value
                    elif symbol >> 4 != 15:
                        break
                    k += 1
                    if k > 63:
                        break
                    continue
                if one:
                    k, one = np.full(len(alive), k, np.int64), False
                symbol = np.broadcast_to(np.int64(symbol), len(alive)) if isinstance(symbol, int) else symbol
                run, put = symbol >> 4, (symbol & 15) > 0
                k = k + run
                if (k[put] > 63).any():
                    raise ValueError("damaged JPEG scan")
                out[u, b, k[put], alive[put]] = value[put]
                k = k + 1
                on = (k < 64) & (put | (run == 15))
                if not on.all():
                    alive, k = alive[on], k[on]
    return out.transpose(3, 0, 1, 2)


def decode(files: list[bytes]) -> list[dict]:
    """Of each file: width, height, coefficients [MCU, block of the MCU, 64] in zigzag order, luminance thumbnail and comments."""
    import numpy as np

    images = [parse(f) for f in files]
    groups: dict = {}
    for i, image in enumerate(images):
        key = (tuple(sorted(image["huffman"].items())), image["parts"], image["tables"], image["restart"] == 1)
        groups.setdefault(key, []).append(i)
    for (huffman, *_), members in groups.items():
        dc = {slot & 15: _lookup(*raw) for slot, raw in huffman if slot < 16}
        ac = {slot & 15: _lookup(*raw) for slot, raw in huffman if slot >= 16}
        blocks = _blocks(images[members[0]])
        buffers, starts, units, base, sizes = [], [], [], 0, []
        for i in members:
            image = images[i]
            columns, rows = _shape(image)
            buffer, begin, _ = _intervals(image.pop("scan"))
            step = image["restart"] or columns * rows
            if len(begin) != -(-columns * rows // step):
                raise ValueError("damaged JPEG scan")
            buffers.append(buffer)
            starts.append(begin + base)
            base += len(buffer)
            units.append(np.minimum(step, columns * rows - step * np.arange(len(begin))))
            sizes.append(len(begin))
        buffer, starts, units = np.concatenate(buffers), np.concatenate(starts), np.concatenate(units)
        parts = []
        for at in range(0, len(starts), SLICE):
            s, u = starts[at : at + SLICE], units[at : at + SLICE]
            low, high = int(s[0]), int(starts[at + SLICE]) if at + SLICE < len(starts) else len(buffer)
            got = _decode_lanes(buffer[low:high], s - low, u, blocks, dc, ac)
            parts.append(got[np.arange(got.shape[1])[None, :] < u[:, None]])
        coefficients = np.concatenate(parts)
        at = 0
        for i in members:
            columns, rows = _shape(images[i])
            images[i]["coefficients"] = coefficients[at : at + columns * rows]
            at += columns * rows
    for image in images:
        columns, rows = _shape(image)
        _, across, down, quant = image["parts"][0]
        light = image["coefficients"][:, : across * down, 0].astype(np.int64) * image["quant"][quant][0]
        light = np.clip((light + 4) // 8 + 128, 0, 255).astype(np.uint8)
        light = light.reshape(rows, columns, down, across).transpose(0, 2, 1, 3).reshape(rows * down, columns * across)
        image["thumbnail"] = light[: -(-image["height"] // 8), : -(-image["width"] // 8)]
    return images


def payload_of(image: dict) -> bytes:
    """The bytes that encode() stored."""
    import numpy as np

    note = next((c for c in image["comments"] if c.startswith(b"units=")), None)
    if note is None:
        raise ValueError("the image holds no payload")
    values = image["coefficients"][: int(note[6:])]
    return np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()


def difference_hash(thumbnail) -> int:
    """64 bits: of 8 rows of 9 samples, whether each is darker than the next."""
    import numpy as np

    height, width = thumbnail.shape
    small = thumbnail[(np.arange(8) * height) // 8][:, (np.arange(9) * width) // 9]
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def _store(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for part in chunks(batches, "text", 1 << 20):
        sizes, media = [], []
        for text in part.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            media.append(encode(raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text as a JPEG that holds its bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(mapped, _store, "doc_id long, n_bytes long, media binary")


FEATURES = "width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, thumbnail_hash string, thumbnail_sha256 string"


def _features(batches: Iterator) -> Iterator:
    import hashlib
    import zlib

    import pyarrow as pa

    names = [x.split()[0] for x in FEATURES.split(", ")]
    for part in chunks(batches, "media", 2 << 20):
        files = part.column("media").to_pylist()
        rows = []
        for data, image in zip(files, decode(files)):
            payload, light = payload_of(image), image["thumbnail"]
            rows.append((image["width"], image["height"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(light):016x}", hashlib.sha256(light.tobytes()).hexdigest()))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays([*(part.column(i) for i, n in enumerate(part.schema.names) if n != "media"), *columns], names=[*(n for n in part.schema.names if n != "media"), *names])


def media_features(media: DataFrame) -> DataFrame:
    """media (columns doc_id, n_bytes and media) with dimensions, payload digests and thumbnail hashes in place of the files."""
    return media.select("doc_id", "n_bytes", "media").transform(mapped, _features, f"doc_id long, n_bytes long, {FEATURES}")


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text through a JPEG and back, with features of the image."""
    found = media_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash", F.substring("thumbnail_sha256", 1, 16))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
