"""What the learned scorers share: a bounded labelled sample, and how well scores rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, y`` of about ``most`` labelled documents at most, none of them held out.

    The choice is by a hash of the id, so it is the same on every run. Only ids and labels are
    counted and dealt; the sample's ids (``most`` pairs of numbers) are broadcast to the texts."""
    y = F.col(label).cast("int")
    known = labels.select("doc_id", y.alias("y")).filter(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # the first ``most`` of so many equal parts of all 64-bit numbers
    upto = min(2**63 - 1, most * 2**64 // max(1, known.count()) - 2**63)
    chosen = known.filter(F.xxhash64(F.lit("sample"), "doc_id") <= F.lit(upto))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")


def keep(docs: DataFrame, model, least: float = 0.0, below: float = float("inf")) -> DataFrame:
    """The rows of ``docs``, whole, whose texts score from ``least`` to under ``below``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = [shared.value.score(texts[n: n + 500]) for n in range(0, len(texts), 500)]
            s = np.clip(np.concatenate(got) if got else np.zeros(0), 0.0, 1.0)
            yield batch.filter(pa.array((s >= least) & (s < below)))
        shared.value.forget()

    return docs.mapInArrow(run, docs.schema)


def auc(y: np.ndarray, score: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    s = score[order]
    edge = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(edge, len(s)))
    rank[order] = np.repeat(edge + (size + 1) / 2, size)
    pos = y == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
