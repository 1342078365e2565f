"""Landmarks by motif: every window that matches a catalogued pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, ship
from .catalog import SKETCH, Enzyme

PARTS = re.compile(r"(\[[A-Z]+\]|[A-Z]+)(?:\{(\d+)\})?")
#: Landmark rows: series, contig, place in file order, position in the contig, letters, source, strand.
LANDMARKS = "genome string, contig_id long, ord long, pos long, seq string, enzyme string, strand string"


#: Bytes that are bases.
KNOWN = np.isin(np.arange(256), np.frombuffer(b"ACGT", np.uint8))
#: Letters searched at once; what the search holds is some thirty times as many bytes.
SLICE = 1 << 20


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; a longer row is one of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def _anchors(pattern: str) -> list[tuple[int, str]]:
    """The places of a pattern that not every base fits, and the bases that do."""
    at, out = 0, []
    for letters, count in PARTS.findall(pattern):
        each = [letters] if letters[0] == "[" else list(letters)
        for part in each:
            bases = part.strip("[]")
            out += [(at + n, bases) for n in range(int(count or 1)) if bases != "ACGT"]
            at += int(count or 1)
    return out


def _starts(text: np.ndarray, unknown: np.ndarray, enzyme: Enzyme) -> tuple[np.ndarray, np.ndarray]:
    """Where a window of known bases fits the enzyme, and whether it fits the forward pattern."""
    n = len(text) - enzyme.length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    fits = []
    for _, pattern in enzyme.patterns:
        at = np.ones(n, bool)
        for place, bases in _anchors(pattern):
            here = text[place: place + n]
            at &= reduce(np.logical_or, (here == ord(c) for c in bases))
        fits.append(at)
    found = np.flatnonzero(reduce(np.logical_or, fits))
    found = found[unknown[found + enzyme.length] == unknown[found]]
    return found, fits[0][found]


def digest(contigs: DataFrame, enzymes: list[Enzyme], truncate: int | None = None) -> DataFrame:
    """Landmarks of ``contigs`` (genome, contig_id, seq), in the order of enzymes, then positions.

    One pass in Arrow batches, with no shuffle: sequences of about ``SLICE`` letters stand end to end, a
    separator between them, and are searched at once, so a worker's memory depends on no batch's size. The forward pattern wins where both match. ``truncate`` cuts
    longer landmarks to that length."""
    ship(contigs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["genome", "contig_id", "ord", "pos", "seq", "enzyme", "strand"]
        kind = pa.array([e.name for e in enzymes], pa.string())
        for batch in by_size(batches, "seq"):
            seqs = [(s or "").encode("ascii", "replace") for s in batch.column("seq").to_pylist()]
            text = np.frombuffer(b"\n".join(seqs), np.uint8)
            begin = np.cumsum([0, *(len(s) + 1 for s in seqs)])[:-1]
            unknown = np.append(0, np.cumsum(~KNOWN[text], dtype=np.int32))
            hits = [_starts(text, unknown, e) for e in enzymes]
            at = np.concatenate([h[0] for h in hits])
            plus = np.concatenate([h[1] for h in hits])
            which = np.repeat(np.arange(len(enzymes)), [len(h[0]) for h in hits])
            contig = np.searchsorted(begin, at, side="right") - 1
            order = np.lexsort((at, which, contig))
            at, plus, which, contig = at[order], plus[order], which[order], contig[order]
            first = np.flatnonzero(np.append(True, contig[1:] != contig[:-1])) if len(at) else at
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            width = np.array([min(e.length, truncate or e.length) for e in enzymes], np.int64)[which]
            edge = np.append(0, np.cumsum(width))
            letters = text[np.repeat(at - edge[:-1], width) + np.arange(edge[-1])]
            tags = pa.StringArray.from_buffers(len(at), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(letters.tobytes()))
            row = pa.array(contig)
            yield pa.RecordBatch.from_arrays(
                [batch.column("genome").take(row), batch.column("contig_id").take(row), pa.array(place), pa.array(at - begin[contig]), tags, kind.take(pa.array(which)), pa.array(np.where(plus, "+", "-").tolist(), pa.string())], names
            )

    return contigs.select(F.col("genome").cast("string"), F.col("contig_id").cast("long"), "seq").mapInArrow(run, LANDMARKS)


def digest_native(contigs: DataFrame, enzyme: Enzyme) -> DataFrame:
    """The same for one enzyme by DataFrame operations alone: a sequence is split before every window that
    fits, which takes one pass over it, and only hits become rows; they start where the pieces do."""
    n = enzyme.length
    pieces = F.split("seq", f"(?=({'|'.join(f'({p})' for _, p in enzyme.patterns)}))", -1)
    whole = contigs.filter(F.length("seq") >= n).select("genome", F.col("contig_id").cast("long").alias("contig_id"), "seq", F.transform(pieces, F.length).alias("each"))
    # a window at the very beginning has no piece before it
    ends = F.aggregate("each", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    found = whole.filter((F.size("each") > 1) | F.col("seq").rlike(f"^({'|'.join(p for _, p in enzyme.patterns)})")).select("genome", "contig_id", "seq", F.explode(ends).alias("p"))
    found = found.select("genome", "contig_id", F.col("p").cast("long").alias("pos"), F.expr(f"substring(seq, p + 1, {n})").alias("tag"))
    strand = F.lit(None).cast("string")
    for s, pattern in reversed(enzyme.patterns):
        strand = F.when(F.col("tag").rlike(f"^{pattern}$"), s).otherwise(strand)
    return found.withColumn("strand", strand).filter(F.col("strand").isNotNull()).select(
        "genome", "contig_id", "pos", F.col("tag").alias("seq"), F.lit(enzyme.name).alias("enzyme"), "strand"
    )


def landmark_source(landmarks: DataFrame) -> DataFrame:
    """``genome, source``: ``sketch`` if all landmarks are hashed, ``enzyme`` if none, else ``mixed``."""
    sketched = F.col("enzyme") == SKETCH
    return landmarks.groupBy("genome").agg(
        F.when(F.bool_and(sketched), "sketch").when(F.bool_or(sketched), "mixed").otherwise("enzyme").alias("source")
    )


def reject_mixed(landmarks: DataFrame) -> DataFrame:
    mixed = landmark_source(landmarks).filter("source = 'mixed'").limit(1).collect()
    if mixed:
        raise ValueError(f"series {mixed[0]['genome']} mixes landmark sources")
    return landmarks
