"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is drawn from the labelled sample by smoothed log-odds.
A text's features are the lexicon's densities, how near its entries stand to second-person pronouns,
capitals, punctuation, and how often words are obfuscated (an entry shows only after signs inside
the word are dropped or digits are read as letters). Trees are fitted on histograms of the features;
an isotonic curve, fitted to scores of trees that did not see the row, turns margins into
probabilities.

The sample is bounded by ``most``; all rows are scored, whole, where they lie. Null texts count as
empty and get the score of a text without any features. Ids, sources and languages are not used.
With labels of one kind only, or none, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices
from .learning import labelled_sample

# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros".split()
)
LEET = str.maketrans("013457@$!", "oieastasi")
_edges = re.compile(r"^[\W_]+|[\W_]+$")
_inside = re.compile(r"[\W_]+")
FEATURES = (
    "words", "word_hits", "stem_hits", "weight", "strongest", "near_you", "you", "capital_words", "capital_letters",
    "exclamations", "punctuation", "digits", "hidden_hits", "mixed_words", "log_length",
)


def forms(word: str) -> tuple[str, str]:
    """A word without its edges' signs, and with its obfuscations undone."""
    bare = _edges.sub("", word.lower())
    return bare, _inside.sub("", word.lower().translate(LEET))


def beginnings(bare: str) -> Iterator[str]:
    return (bare[:n] + "-" for n in (4, 5, 6) if len(bare) > n)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    _known: dict[str, tuple] = field(default_factory=dict)

    def look(self, word: str) -> tuple:
        """word weight, stem weight, hidden weight, second person, all capitals, mixed signs."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 150_000:
                self._known.clear()
            bare, clear = forms(word)
            w = self.words.get(bare, 0.0)
            s = max((self.stems.get(b, 0.0) for b in beginnings(bare)), default=0.0)
            hidden = 0.0
            if clear != bare and not w:
                hidden = max(self.words.get(clear, 0.0), max((self.stems.get(b, 0.0) for b in beginnings(clear)), default=0.0) if not s else 0.0)
            core = _edges.sub("", word)
            mixed = bool(_inside.search(core)) or (any(c.isdigit() for c in core) and any(c.isalpha() for c in core))
            found = self._known[word] = (w, s, hidden, bare in SECOND_PERSON, len(core) > 1 and core.isupper(), mixed)
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    look = lexicon.look
    seen = [look(w) for w in words]
    letters = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND[letters], minlength=5)
    m = max(1, len(letters))
    hits = [k for k, x in enumerate(seen) if x[0] or x[1] or x[2]]
    you = [k for k, x in enumerate(seen) if x[3]]
    near = 0.0
    if hits and you:
        at = np.searchsorted(you, hits)
        y = np.array([-10**9, *you, 10**9])
        gap = np.minimum(y[at + 1] - hits, hits - y[at])
        near = float((1 / (1 + np.abs(gap))).sum())
    weight = [max(seen[k][:3]) for k in hits]
    return [
        len(words), sum(1 for k in hits if seen[k][0]) / n, sum(1 for k in hits if seen[k][1]) / n, sum(weight) / n, max(weight, default=0.0), near / n,
        len(you) / n, sum(x[4] for x in seen) / n, kinds[1] / m, kinds[3] / m, kinds[4] / m, kinds[2] / m,
        sum(1 for k in hits if seen[k][2]) / n, sum(x[5] for x in seen) / n, float(np.log1p(len(words))),
    ]


def _kinds() -> np.ndarray:
    """0 other, 1 capital, 2 digit, 3 exclamation or question mark, 4 other sign."""
    kind = np.zeros(256, np.int64)
    for b in range(33, 127):
        c = chr(b)
        kind[b] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "!?" else 0 if c.isalpha() else 4
    return kind


_KIND = _kinds()


@dataclass
class Trees:
    """Boosted regression trees on binned features, stored level by level."""

    edges: list[np.ndarray]
    depth: int
    base: float
    split: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin and leaf value by node

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.split:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(v, quantiles)) if len(v) else np.zeros(0) for v in x.T]
    edges = [np.unique(np.append(e, np.quantile(v[v > v.min()], quantiles))) if (v > v.min()).any() else e for e, v in zip(edges, x.T, strict=True)]
    share = (y.sum() + 1) / (len(y) + 2)
    trees = Trees(edges, depth, float(np.log(share / (1 - share))), [])
    b, margin = trees.bins(x).astype(np.int64), np.full(len(y), trees.base)
    width = max(len(e) for e in edges) + 1
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, width, np.int64), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain = np.zeros((count, b.shape[1], width))
            for k in range(b.shape[1]):
                cell = (at - first) * width + b[:, k]
                sg = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
                sh = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
                rg, rh = sg[:, -1:] - sg, sh[:, -1:] - sh
                gain[:, k] = sg**2 / (sh + ridge) + rg**2 / (rh + ridge) - sg[:, -1:] ** 2 / (sh[:, -1:] + ridge)
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[first: first + count] = best // width
            cut[first: first + count] = np.where(good, best % width, width)
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = np.bincount(at - inner, g, leaves) / (np.bincount(at - inner, h, leaves) + ridge) * rate
        trees.split.append((feature, cut, leaf))
        margin += leaf[at - inner]
    return trees


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising curve from margins to smoothed shares of label 1."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, m, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, _, high = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = high
    share = float(y.mean()) if len(y) else 0.5
    at, value = [], []
    for v, n, low, high in pools:
        p = (v + prior * share) / (n + prior)
        for m in (low, high) if high > low else (low,):
            at.append(m)
            value.append(p)
    return np.array(at), np.maximum.accumulate(np.array(value))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    curve: tuple[np.ndarray, np.ndarray]
    share: float

    def forget(self) -> None:
        """Drop what is remembered of words: a worker that goes on to other work keeps its models."""
        self.lexicon._known.clear()

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.share)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]))
        # A small tilt keeps apart what the curve pools, without leaving [0, 1].
        return 0.999 * np.interp(margin, *self.curve) + 0.001 / (1 + np.exp(-margin))


def fit(sample: DataFrame, entries: int = 400, folds: int = 3) -> Model:
    """Fit on a sample of labelled texts. Only counts of the best ``entries`` and the sample's
    features reach the driver."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            by = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                bare = {forms(w)[0] for w in set(text.split())}
                by[y].update(bare | {b for w in bare for b in beginnings(w)})
            terms = list({*by[0], *by[1]} - {""})
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([by[0][t] for t in terms], pa.int64()), pa.array([by[1][t] for t in terms], pa.int64())],
                ["term", "n0", "n1"],
            )

    size = {int(r["y"]): int(r["n"]) for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Model(Lexicon(), None, (np.zeros(0), np.zeros(0)), (n1 + 1) / (n0 + n1 + 2))
    terms = sample.select("text", "y").mapInArrow(counts, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    least = max(5, n1 // 400)
    best = terms.filter(F.col("n1") >= least).withColumn("odds", odds).withColumn("z", odds / error)
    best = best.filter((F.col("z") > 2.5) & (F.col("odds") > 2)).orderBy(F.desc("z"), "term").limit(entries).collect()
    lexicon = Lexicon()
    for r in best:
        (lexicon.stems if r["term"].endswith("-") else lexicon.words)[r["term"]] = float(r["odds"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            x = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["doc_id", "x", "y"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "y").mapInArrow(extract, f"doc_id {kind}, x array<double>, y int").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(rows["x"].tolist(), float), rows["y"].to_numpy()
    fold = np.arange(len(y)) % folds
    apart = np.zeros(len(y))
    for k in range(folds):
        apart[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(lexicon, boost(x, y), isotonic(apart, y), float(y.mean()))


def score(docs: DataFrame, model, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for all rows. ``model`` has ``score(texts)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = [shared.value.score(texts[n: n + 500]) for n in range(0, len(texts), 500)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(s, 0.0, 1.0))], ["doc_id", "score"])
        shared.value.forget()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    out = out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 8_000, threshold: float = 0.5) -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels, "toxic", most)), threshold)
