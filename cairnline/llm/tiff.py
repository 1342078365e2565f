"""TIFF as a media column: image directories walked, strips and tiles decoded, one row per page.

Read: both byte orders, chains of directories, 8-bit samples, chunky pixels, strips or tiles stored
plain, as PackBits, LZW or deflate, with or without horizontal differencing. Written: the same, little
endian. ``pages`` turns a binary column into rows; ``store`` keeps texts losslessly as pixels.

Defined results: null or empty content gives no page; content that is not a readable TIFF gives one
row with ``error`` set and no pixels, after the pages that could be read. Directory chains that loop
are an error. Memory: one file and one page at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class BadImage(ValueError):
    pass


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def pack_bits(row: bytes) -> bytes:
    out, n, lit = bytearray(), 0, 0
    while n < len(row):
        run = 1
        while n + run < len(row) and run < 128 and row[n + run] == row[n]:
            run += 1
        if run >= 3:
            while lit < n:
                part = row[lit: min(n, lit + 128)]
                out += bytes([len(part) - 1]) + part
                lit += len(part)
            out += bytes([257 - run, row[n]])
            lit = n + run
        n += run
    while lit < len(row):
        part = row[lit: lit + 128]
        out += bytes([len(part) - 1]) + part
        lit += len(part)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, n = bytearray(), 0
    while n < len(data) and len(out) < size:
        c = data[n]
        if c < 128:
            out += data[n + 1: n + 2 + c]
            n += c + 2
        elif c > 128:
            out += data[n + 1: n + 2] * (257 - c)
            n += 2
        else:
            n += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, held, width = bytearray(), 256, 9, 9
    table: dict[tuple[int, int], int] = {}
    code, nxt = -1, 258
    for b in data:
        if code < 0:
            code = b
            continue
        found = table.get((code, b))
        if found is not None:
            code = found
            continue
        acc, held = acc << width | code, held + width
        table[code, b] = nxt
        nxt += 1
        if nxt == 4095:
            acc, held = acc << width | 256, held + width
            table.clear()
            nxt, width = 258, 9
        elif nxt > (1 << width) - 1:
            width += 1
        while held >= 8:
            held -= 8
            out.append(acc >> held)
            acc &= (1 << held) - 1
        code = b
    if code >= 0:
        acc, held = acc << width | code, held + width
        if nxt + 1 > (1 << width) - 1 and width < 12:
            width += 1
    acc, held = acc << width | 257, held + width
    pad = -held % 8
    return bytes(out) + (acc << pad).to_bytes((held + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out, got = [], 0
    start = [bytes([n]) for n in range(256)] + [b"", b""]
    table, last, width = list(start), b"", 9
    acc = held = 0
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = list(start), b"", 9
            continue
        if not last:
            if code > 255:
                raise BadImage("LZW stream begins with an unknown code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise BadImage("LZW code out of range")
            table.append(last + entry[:1])
        out.append(entry)
        got += len(entry)
        last = entry
        if got >= size:
            break
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data
    elif compression == PACKBITS:
        got = unpack_bits(data, size)
    elif compression == LZW:
        got = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            got = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadImage(f"deflate: {e}") from e
    else:
        raise BadImage(f"compression {compression} is not supported")
    if len(got) < size:
        raise BadImage(f"{len(got)} bytes where {size} belong")
    return got[:size]


def encode(data: bytes, compression: int, row: int) -> bytes:
    if compression == PACKBITS:
        return b"".join(pack_bits(data[n: n + row]) for n in range(0, len(data), row))
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1) if compression == DEFLATE else data


def difference(block: np.ndarray) -> np.ndarray:
    """Rows by columns by samples: each sample less the one to its left."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undo_difference(block: np.ndarray) -> np.ndarray:
    return np.cumsum(block, axis=1, dtype=np.uint8)


def read_pages(data: bytes, most_bytes: int = 1 << 30) -> Iterator[Page]:
    if data[:2] not in (b"II", b"MM"):
        raise BadImage("no byte order mark")
    e = "<" if data[:2] == b"II" else ">"
    if len(data) < 8 or struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise BadImage("not a TIFF")
    at, seen, number = struct.unpack_from(e + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            raise BadImage("the chain of directories loops")
        seen.add(at)
        try:
            tags, at = _directory(data, e, at)
            page = _page(data, tags, number, most_bytes)
        except (struct.error, KeyError, IndexError) as x:
            raise BadImage(f"broken directory: {x!r}") from x
        yield page
        number += 1


def _directory(data: bytes, e: str, at: int) -> tuple[dict[int, tuple], int]:
    count = struct.unpack_from(e + "H", data, at)[0]
    tags: dict[int, tuple] = {}
    for n in range(count):
        tag, kind, many = struct.unpack_from(e + "HHI", data, at + 2 + 12 * n)
        if kind not in (1, 3, 4):
            continue
        size = TYPE_SIZE[kind] * many
        where = at + 10 + 12 * n if size <= 4 else struct.unpack_from(e + "I", data, at + 10 + 12 * n)[0]
        tags[tag] = struct.unpack_from(f"{e}{many}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
    return tags, struct.unpack_from(e + "I", data, at + 2 + 12 * count)[0]


def _page(data: bytes, tags: dict[int, tuple], number: int, most: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = tags[WIDTH][0], tags[LENGTH][0], one(SAMPLES, 1)
    if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise BadImage("only chunky 8-bit samples are supported")
    if width * height * samples > most:
        raise BadImage("page too large")
    compression, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags
    if predictor not in (1, 2):
        raise BadImage(f"predictor {predictor} is not supported")
    whole = np.zeros((height, width, samples), np.uint8)
    if tiled:
        w, h = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
        places = [(y, x) for y in range(0, height, h) for x in range(0, width, w)]
        offsets, sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        w, h = width, min(height, one(ROWS_PER_STRIP, height)) or 1
        places = [(y, 0) for y in range(0, height, h)]
        offsets, sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    for (y, x), offset, size in zip(places, offsets, sizes, strict=True):
        rows = h if tiled else min(h, height - y)
        raw = decode(data[offset: offset + size], compression, rows * w * samples)
        block = np.frombuffer(raw, np.uint8).reshape(rows, w, samples)
        if predictor == 2:
            block = undo_difference(block)
        whole[y: y + rows, x: x + w] = block[: height - y, : width - x]
    return Page(number, width, height, samples, compression, predictor, tiled, whole.tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 64) -> bytes:
    """A little-endian file of the images (rows by columns by samples, 8 bits), one page each."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width, samples = image.shape
        w, h = (tile, tile) if tile else (width, rows_per_strip)
        offsets, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y: y + h, x: x + w]
                if tile and block.shape[:2] != (h, w):
                    full = np.zeros((h, w, samples), np.uint8)
                    full[: block.shape[0], : block.shape[1]] = block
                    block = full
                raw = (difference(block) if predictor == 2 else block).tobytes()
                coded = encode(raw, compression, w * samples)
                offsets.append(len(out))
                sizes.append(len(coded))
                out += coded + b"\0" * (len(coded) & 1)
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression])]
        tags += [(PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [
            (STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_BYTES, 4, sizes)
        ]
        entries = b""
        for tag, kind, values in sorted(tags):
            value = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(value) > 4:
                place = len(out)
                out += value + b"\0" * (len(value) & 1)
                value = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        out[link: link + 4] = struct.pack("<I", len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


def pages(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """One row per page: the key, ``page, width, height, samples, compression, predictor, tiled,
    pixels, error``."""
    names = ["page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]
    kinds = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in enumerate(batch.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    for p in read_pages(data) if data else ():
                        rows.append((p.number, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels, None))
                except BadImage as e:
                    rows.append((len(rows), None, None, None, None, None, None, None, str(e)))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n] * len(rows))), *columns], [key, *names])

    rows = files.select(key, F.col(content).cast("binary").alias(content))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string")


PIXELS, SAMPLES_STORED = 64, 3
ROW = PIXELS * SAMPLES_STORED


def payload(text: bytes) -> bytes:
    size = max(ROW, -(-len(text) // ROW) * ROW)
    return text.ljust(size, b" ")


def store_bytes(data: bytes, page_rows: int = 4096) -> bytes:
    """A payload as RGB rows; codec, predictor, and strips or tiles are dealt
    evenly by the content's checksum, so equal payloads are stored alike."""
    image = np.frombuffer(data, np.uint8).reshape(-1, PIXELS, SAMPLES_STORED)
    images = [image[n: n + page_rows] for n in range(0, len(image), page_rows)]
    k = zlib.crc32(data)
    codec, predictor, tile = (LZW, PACKBITS, DEFLATE)[k % 3], 1 + k // 3 % 2, 32 * (k // 6 % 2)
    return write(images, codec, predictor, tile)


def digests(docs: DataFrame) -> DataFrame:
    """Store every whole text, read the stored bytes back, and describe what was read."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def describe(text: bytes) -> tuple:
        media = store_bytes(payload(text))
        found = list(read_pages(media))
        back = b"".join(p.pixels for p in found)
        x = np.frombuffer(back, np.uint8)
        histogram = np.bincount(x >> 5, minlength=8)
        first = found[0]
        feature = f"pages={len(found)} size={first.width}x{sum(p.height for p in found)} codec={first.compression} predictor={first.predictor} tiled={int(first.tiled)} mean={x.mean():.4f} histogram={'/'.join(map(str, histogram))}"
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")
