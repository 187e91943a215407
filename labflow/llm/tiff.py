"""TIFF: writing and reading of 8-bit grey pages in strips or tiles."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.common import byte_values, lean, table

# Fixed values of the format: tags, and how many bytes a value of each type has.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST, MOST_CODE = 256, 257, 258, 4094

#: Bytes of a page that is read at most; a directory may declare any.
MOST_BYTES = 1 << 30
#: Samples in a row, and rows of a page, a strip and a tile, of what the query stores.
ROW, PAGE_ROWS, STRIP_ROWS, TILE_ROWS = 64, 4096, 256, 64


def packbits(data: bytes) -> bytes:
    out = bytearray()

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(len(part[i : i + 128]) - 1)
            out.extend(part[i : i + 128])

    at = 0
    for m in re.finditer(rb"(.)\1{2,}", data, re.DOTALL):
        literal(data[at : m.start()])
        n, at = m.end() - m.start(), m.end()
        while n > 1:
            k = min(n, 128)
            out += bytes([257 - k, m[1][0]])
            n -= k
        if n:
            literal(m[1])
    literal(data[at:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, n = [], 0, 0
    while n < size:
        k = data[at]
        if k < 128:
            part, at = data[at + 1 : at + 2 + k], at + 2 + k
        elif k > 128:
            part, at = data[at + 1 : at + 2] * (257 - k), at + 2
        else:
            part, at = b"", at + 1
        out.append(part)
        n += len(part)
    return b"".join(out)[:size]


def lzw(data: bytes) -> bytes:
    codes, held, bits = [(CLEAR, 9)], 0, 9
    known: dict[bytes, int] = {}
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in known:
            word = longer
            continue
        codes.append((known[word] if len(word) > 1 else word[0], bits))
        known[longer] = FIRST + len(known)
        nxt = FIRST + len(known)
        if nxt > MOST_CODE:
            codes.append((CLEAR, bits))
            known, bits = {}, 9
        elif nxt >= 1 << bits:
            bits += 1
        word = data[i : i + 1]
    if word:
        codes.append((known[word] if len(word) > 1 else word[0], bits))
        if FIRST + len(known) + 1 >= 1 << bits and bits < 12:
            bits += 1
    codes.append((END, bits))
    out, n = bytearray(), 0
    for code, width in codes:
        held, n = held << width | code, n + width
        while n >= 8:
            out.append(held >> n - 8 & 255)
            n -= 8
        held &= (1 << n) - 1
    if n:
        out.append(held << 8 - n & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    words, last, bits = list(single), b"", 9
    held = n = total = 0
    out = []
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code = held >> n
        held &= (1 << n) - 1
        if code == CLEAR:
            words, last, bits = list(single), b"", 9
            continue
        if code == END:
            break
        if not last:
            if code >= CLEAR:
                raise ValueError("an LZW code that no word has")
            word = words[code]
        else:
            if code > len(words):
                raise ValueError("an LZW code that no word has")
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
            if len(words) + 1 >= 1 << bits and bits < 12:
                bits += 1
        out.append(word)
        total += len(word)
        if total >= size:
            break
        last = word
    return b"".join(out)[:size]


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: lambda: data, LZW: lambda: lzw(data), DEFLATE: lambda: zlib.compress(data, 1), PACKBITS: lambda: packbits(data)}[compression]()


def _unpack(data: bytes, size: int, compression: int) -> bytes:
    if compression == NONE:
        out = data[:size]
    elif compression == LZW:
        out = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    else:
        raise ValueError(f"compression {compression} isn't known")
    return out


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, planar: bool = False) -> bytes:
    """A little-endian file of 8-bit pages (height, width) or (height, width, samples), in strips or, with tile (height, width), in tiles; with planar, one sample after the other."""
    body = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape[:2]
        samples = page.shape[2] if page.ndim == 3 else 1
        page = page.reshape(height, width, samples)
        h, w = tile or (min(strip_rows, height), width)
        offsets, sizes = [], []
        for plane in [page[:, :, i : i + 1] for i in range(samples)] if planar else [page]:
            for y in range(0, height, h):
                for x in range(0, width, w):
                    part = plane[y : y + h, x : x + w]
                    if tile:
                        part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                    packed = _pack(part.astype(np.uint8).tobytes(), compression)
                    offsets.append(len(body))
                    sizes.append(len(packed))
                    body += packed
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        entries += [(PLANAR, 3, [2])] if planar else []
        entries += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_SIZES, 4, sizes)]
        directory = struct.pack("<H", len(entries))
        for tag, kind, values in sorted(entries):
            raw = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
            if len(raw) > 4:
                body += b"\0" * (len(body) % 2)
                raw, at = struct.pack("<I", len(body)), raw
                body += at
            directory += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        body += b"\0" * (len(body) % 2)
        struct.pack_into("<I", body, link, len(body))
        link = len(body) + len(directory)
        body += directory + b"\0\0\0\0"
    return bytes(body)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: np.ndarray


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; a directory that comes again ends them."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                size, code = TYPES[kind]
                where = at + 10 + 12 * i
                if size * count > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        one = lambda tag, other: tags.get(tag, (other,))[0]  # noqa: B023, E731
        width, height, samples, compression, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if any(b != 8 for b in tags.get(BITS, (8,))) or predictor not in (1, 2):
            raise ValueError("only 8-bit samples with predictor 1 or 2 are read")
        tiled, planes = TILE_OFFSETS in tags, samples if one(PLANAR, 1) == 2 else 1
        w, h = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if min(width, height, samples, w, h) < 1:
            raise ValueError("a page, strip or tile without any sample")
        if max(height * width, h * w) * samples > MOST_BYTES:
            raise ValueError(f"a page or tile of over {MOST_BYTES} bytes")
        across, down = -(-width // w), -(-height // h)
        parts = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES], strict=True))
        if len(parts) != across * down * planes:
            raise ValueError(f"{len(parts)} strips or tiles where {across * down * planes} make up the page")
        page = np.zeros((height, width, samples), np.uint8)
        for k, (offset, size) in enumerate(parts):
            plane, k = divmod(k, across * down)
            y, x = k // across * h, k % across * w
            rows, depth = h if tiled else min(h, height - y), samples // planes
            part = np.frombuffer(_unpack(data[offset : offset + size], rows * w * depth, compression), np.uint8).reshape(rows, w, depth)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            page[y : y + rows, x : x + w, plane * depth : (plane + 1) * depth] = part[: height - y, : width - x]
        yield Page(width, height, samples, compression, predictor, tiled, page)


def pages(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each page of the TIFF files in a binary column: the other columns, page (from 0), width, height, samples, compression, predictor, tiled, data and error.

    A null file gives no rows; one that can't be read, or declares a page of more
    than MOST_BYTES, gives the pages before the fault and then a row with the
    error and no data. Columns of these names are replaced, all others stay;
    repeated rows stay; no rows give no rows.
    """
    more = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, data binary, error string"
    kind = files.sparkSession.createDataFrame([], more).schema
    files = files.drop(*kind.names)
    at = files.columns.index(content)
    others = [c for c in files.columns if c != content]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(at).to_pylist()):
                if x is None:
                    continue
                k, error = -1, None
                own = [b.column(j).slice(i, 1) for j, c in enumerate(b.schema.names) if c != content]
                row = lambda values: pa.RecordBatch.from_arrays([*own, *(pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string()), strict=True))], names=[*others, *kind.names])  # noqa: B023, E731
                try:
                    for k, p in enumerate(read(x)):
                        yield row([k, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.data.tobytes(), None])
                except (ArithmeticError, LookupError, MemoryError, ValueError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                if error:
                    yield row([k + 1, None, None, None, None, None, None, None, error])

    return lean(files).mapInArrow(each, type(kind)([*(f for f in files.schema.fields if f.name != content), *kind.fields]))


def store(data: bytes) -> tuple[bytes, int]:
    """A file that holds the bytes, zeros appended up to a positive multiple of 64, in pages of 64 samples a row; and how many bytes that is.

    Its form follows the bytes: their CRC-32 chooses the compression, strips or tiles, and the predictor.
    """
    payload = data + b"\0" * (-len(data) % ROW if data else ROW)
    crc = zlib.crc32(payload)
    compression = (DEFLATE, PACKBITS, LZW, NONE)[crc & 3]
    grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sheets = [grey[i : i + PAGE_ROWS] for i in range(0, len(grey), PAGE_ROWS)]
    return write(sheets, compression, 2 if crc & 4 and compression in (LZW, DEFLATE) else 1, (TILE_ROWS, ROW) if crc & 8 else None), len(payload)


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of docs (doc_id, text).

    Each text is stored as a TIFF and read back from its bytes, page by page;
    null counts as empty. feature: pages, rows, mean and spread of the samples,
    and how many values occur.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in byte_values(b.column(1)):
                media, _ = store(x)
                digest, n, tail, count, height = hashlib.sha256(), 0, b"", 0, 0
                histogram = np.zeros(256, np.int64)
                for page in read(media):
                    own = page.data.tobytes()
                    digest.update(own)
                    n, tail, count, height = n + len(own), own[-64:], count + 1, height + page.height
                    histogram += np.bincount(page.data.ravel(), minlength=256)
                mean = float(histogram @ np.arange(256)) / n
                spread = float(histogram @ (np.arange(256) - mean) ** 2) / n
                feature = f"pages={count};rows={height};mean={mean:.3f};spread={spread**0.5:.3f};values={int((histogram > 0).sum())}"
                rows.append((len(x), n, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
