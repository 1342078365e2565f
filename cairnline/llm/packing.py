"""Best-fit packing by large-item matching.

Texts are tokenized where they lie; only lengths travel further. What to put together is decided on
the histogram of lengths, which has at most ``capacity`` entries however many documents there are:
items above a third of the capacity meet at most twice in a sequence and are matched greedily, the
largest with the largest that still fits; smaller items then go, longest first, into the tightest
gap left. The decision is a list of runs ("items 10 to 99 of length 300 go to sequences 5000 to 5089
at offset 1700"). Each item finds its run by its length and its rank among equals; ranks come from
hashed buckets, so a length that most items share never meets in one task.

Defined results: a null text is empty and has one token, the end mark; equal documents are packed
separately; an empty table gives no rows; only documents longer than the capacity are cut, with the
short piece first. Memory: the plan has at most a few entries for each pair of lengths, whatever the
size of the table; a worker holds the vocabulary and the ids of one text.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, slices

# Characters on whose classes (letter, number, space) all tokenizers agree.
_usual = regex.compile(
    r"[\n\t\r\x20-\x7e\xa1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u044f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"
)


class WordEncoder:
    """Ids of a byte-level merge vocabulary, text by text: nothing is remembered between texts, which costs
    more than it spares where many words are new.

    Texts with special strings or characters out of the ordinary go to the reference library, whose ids
    these are."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: tuple[str, ...]):
        import tiktoken

        self.json_path = json_path
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special

    @cached_property
    def library(self):
        """The reference library, loaded where a text asks for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if _usual.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[tuple, WordEncoder] = {}


def encoder(*key) -> WordEncoder:
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer: tuple, capacity: int, end_id: int) -> DataFrame:
    """Tokenize and cut: ``doc_id, piece, start, length, ids_crc32`` of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier stages' tasks left in this worker
        enc = encoder(*tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                total = len(ids) // 4
                head = total % capacity or capacity
                bounds = [0, *range(min(head, total), total + 1, capacity)]
                for k in range(len(bounds) - 1):
                    a, z = bounds[k], bounds[k + 1]
                    at.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[4 * a: 4 * z]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs ``length, rank, count, bin, offset`` that pack ``counts[length]`` items of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(left, 0)
    bins = 0
    gaps: dict[int, list[list[int]]] = {}

    def put(length: int, count: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], count, first_bin, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first_bin: int, count: int) -> None:
        if gap > 0 and count > 0:
            gaps.setdefault(gap, []).append([first_bin, count])

    large = sorted((n for n in left if n * 3 > capacity), reverse=True)
    for a in large:
        while left[a]:
            left[a] -= 1
            mate = next((b for b in large if b <= min(a, capacity - a) and left[b]), None)
            left[a] += 1
            if mate is None:
                count = left[a]
                leave(capacity - a, bins, count)
                put(a, count, bins, 0)
            else:
                count = left[a] // 2 if mate == a else min(left[a], left[mate])
                leave(capacity - a - mate, bins, count)
                put(a, count, bins, 0)
                put(mate, count, bins, a)
            bins += count
    for n in sorted((n for n in left if n * 3 <= capacity), reverse=True):
        for gap in range(n, capacity):
            while left[n] and gaps.get(gap):
                first, count = gaps[gap].pop()
                take = min(count, left[n])
                put(n, take, first, capacity - gap)
                leave(gap, first + take, count - take)
                leave(gap - n, first, take)
            if not left[n]:
                break
        if left[n]:
            each = capacity // n
            whole, rest = divmod(left[n], each)
            for k in range(each if whole else 0):
                put(n, whole, bins, k * n)
            leave(capacity - each * n, bins, whole)
            for k in range(rest):
                put(n, 1, bins + whole, k * n)
            leave(capacity - rest * n, bins + whole, 1 if rest else 0)
            bins += whole + (rest > 0)
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "count", "bin", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: tuple, capacity: int = 2048, end_id: int = 0, buckets: int = 256) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece.

    ``tokenizer``: path of the library's file, path of the same vocabulary as ranks, the pattern
    that splits words, and the special strings. The files have to be installed on the executors."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id), "pieces")
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    # At most ``capacity`` lengths of ``buckets`` rows each: bounded tables.
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = materialise(sizes.select("length", "bucket", "n", (F.sum("n").over(before) - F.col("n")).alias("before")), "lengths")
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    runs = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(within)).join(sizes.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        first = np.searchsorted(r["length"], np.arange(capacity + 2))
        step = np.int64(1) << 40
        keys = r["length"] * step + r["rank"]
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, n * step + rank, side="right") - 1
            assert (at >= first[n]).all()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(r["bin"][at] + rank - r["rank"][at]), pa.array(r["offset"][at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
