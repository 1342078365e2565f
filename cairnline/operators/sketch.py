"""Landmarks by hash: canonical k-mers whose hash falls under a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .catalog import SKETCH
from .digest import LANDMARKS

_CODE = np.full(256, 4, np.uint8)
for _n, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _n


def splitmix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_sequence(seq: str, k: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions kept, and whether the forward k-mer is the canonical one, for one sequence."""
    if not 1 <= k <= 32 or scale < 1:
        raise ValueError("k must be 1 to 32 and scale at least 1")
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    known = np.minimum(code, 3).astype(np.uint64)
    for j in range(k):
        forward = forward << np.uint64(2) | known[j: n + j]
        reverse |= (np.uint64(3) - known[j: n + j]) << np.uint64(2 * j)
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    low = np.minimum(forward, reverse)
    good = (bad[k:] == bad[:-k]) & (splitmix64(low) < np.uint64(((1 << 64) - 1) // scale))
    at = np.flatnonzero(good)
    return at, forward[at] <= reverse[at]


def sketch(contigs: DataFrame, k: int = 31, scale: int = 750) -> DataFrame:
    """Landmarks of ``contigs`` (genome, contig_id, seq): about one in ``scale`` positions, the same
    wherever the same k-mer occurs and on either strand. One Arrow pass, no shuffle."""
    if not 1 <= k <= 32 or scale < 1:
        raise ValueError("k must be 1 to 32 and scale at least 1")
    ship(contigs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for genome, contig, seq in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                at, plus = sketch_sequence(seq or "", k, scale)
                rows = ([genome] * len(at), [contig] * len(at), range(len(at)), at.tolist(), [seq[p: p + k].upper() for p in at.tolist()], [SKETCH] * len(at), np.where(plus, "+", "-").tolist())
                for column, values in zip(out, rows, strict=True):
                    column.extend(values)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["genome", "contig_id", "ord", "pos", "seq", "enzyme", "strand"])

    return contigs.select("genome", F.col("contig_id").cast("long"), "seq").mapInArrow(run, LANDMARKS)


def splitmix64_native(df: DataFrame, column: str, name: str) -> DataFrame:
    """The same hash of a long column, within range-checked arithmetic: sums by 32-bit halves, products
    by 16-bit limbs. Steps are columns of their own, so no expression repeats another."""
    z = F.col("_z")

    def shifted(bits: int) -> Column:
        return z.bitwiseXOR(F.shiftrightunsigned(z, bits))

    def times(df: DataFrame, b: int) -> DataFrame:
        y = [(b >> 16 * n) & 0xFFFF for n in range(4)]
        df = df.withColumns({f"_x{n}": F.shiftrightunsigned("_z", 16 * n).bitwiseAND(F.lit(0xFFFF)) for n in range(4)})
        for n in range(4):
            total = F.lit(0).cast("long") if n == 0 else F.shiftrightunsigned(f"_t{n - 1}", 16)
            for m in range(n + 1):
                total = total + F.col(f"_x{m}") * F.lit(y[n - m]).cast("long")
            df = df.withColumn(f"_t{n}", total)
        limb = [F.shiftleft(F.col(f"_t{n}").bitwiseAND(F.lit(0xFFFF)), 16 * n) for n in range(4)]
        return df.withColumn("_z", limb[0].bitwiseOR(limb[1]).bitwiseOR(limb[2]).bitwiseOR(limb[3]))

    seed = 0x9E3779B97F4A7C15
    low = F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(seed & 0xFFFFFFFF)
    df = df.withColumn("_low", low)
    high = F.shiftrightunsigned(F.col(column), 32) + F.lit(seed >> 32) + F.shiftrightunsigned("_low", 32)
    df = df.withColumn("_z", F.shiftleft(high.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.col("_low").bitwiseAND(F.lit(0xFFFFFFFF))))
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        df = times(df.withColumn("_z", shifted(bits)), factor)
    steps = [c for c in df.columns if c[0] == "_"]
    return df.withColumn(name, shifted(31)).drop(*steps)
