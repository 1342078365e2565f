"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded from its form (word
lengths, capitals, signs, digits, repetition, sentence ends); gated attention, learned from the
documents' labels alone, weighs the encoded passages; and the weighted sum is scored. Passages are
never labelled themselves.

The training sample is bounded by ``most`` documents, of which all passages are taken (60 bytes a
passage of 64 words); scoring takes all rows and all their passages, where they lie. Null and empty texts
are one empty passage. Ids, sources and languages are not used. With labels of one kind only, or
none, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import labelled_sample
from .toxicity import score

PASSAGE = 64
FEATURES = 15


class WordForms:
    """Numbers for words, and a row of form features for each."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 9), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        try:
            return np.array([number[w] for w in words], np.int64)
        except KeyError:
            for w in words:
                if w not in number:
                    number[w] = len(self.rows)
                    self.rows.append(self._form(w))
            return np.array([number[w] for w in words], np.int64)

    def forms(self, ids: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.rows):
            fresh = np.array(self.rows[len(self.table):], np.float32)
            self.table = np.concatenate([self.table, fresh])
        return self.table[ids]

    @staticmethod
    def _form(w: str) -> tuple:
        n = len(w)
        upper, digit = sum(map(str.isupper, w)), sum(map(str.isdigit, w))
        sign = n - sum(map(str.isalnum, w))
        tail = n - len(w.rstrip("!?%&#*$|~^=+-_<>/\\@.,;:"))
        return (
            n, upper / n, digit / n, sign / n, float(tail >= 2), float(sign == n), float(upper == 1 and w[0].isupper()),
            float(w[-1] in ".!?"), float(n > 1 and upper == sum(map(str.isalpha, w)) > 1),
        )


_forms = WordForms()


def bags(texts: list[str], slice_words: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts, in order: passage features, and the number of passages by text."""
    held, some = 0, []
    for t in texts:
        w = t.split()
        some.append(w)
        held += len(w)
        if held >= slice_words:
            yield _bags(some)
            held, some = 0, []
    if some:
        yield _bags(some)


def _bags(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    if len(_forms.rows) > _forms.most:
        _forms.clear()
    n = np.array([len(w) for w in words], np.int64)
    passages = np.maximum(1, -(-n // PASSAGE))
    total = int(passages.sum())
    first = np.cumsum(passages) - passages
    doc = np.repeat(np.arange(len(n)), n)
    ids = _forms.ids([w for ws in words for w in ws])
    x = np.zeros((total, FEATURES), np.float32)
    if len(ids):
        at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        p = first[doc] + at // PASSAGE
        edge = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(edge, len(p)))
        here = p[edge]
        f = _forms.forms(ids)
        x[here, :9] = np.add.reduceat(f, edge) / size[:, None]
        x[here, 0] /= 10
        same = np.append(False, (ids[1:] == ids[:-1]) & (p[1:] == p[:-1]))
        x[here, 9] = np.add.reduceat(same.astype(np.float32), edge) / size
        key = np.sort(p * np.int64(1 << 32) + ids)
        new = np.append(True, key[1:] != key[:-1])
        x[here, 10] = np.bincount(key[new] >> 32, minlength=total)[here] / size
        runs = np.flatnonzero(new)
        many = np.zeros(total)
        np.maximum.at(many, key[runs] >> 32, np.diff(np.append(runs, len(key))))
        x[here, 11] = many[here] / size
        deviation = np.add.reduceat(f[:, 0] ** 2, edge) / size / 100 - x[here, 0] ** 2
        x[here, 12] = np.sqrt(np.maximum(0, deviation))
        x[here, 13] = size / PASSAGE
        x[here, 14] = 1
    return x, passages


@dataclass
class Attention:
    """Encoder, gated attention and classifier; parameters by name."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    share: float

    @staticmethod
    def begin(x: np.ndarray, share: float, width: int = 16, gate: int = 8) -> Attention:
        rng = np.random.default_rng(7)
        d = x.shape[1]
        p = {
            "E": rng.normal(0, d**-0.5, (d, width)), "e": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, gate)),
            "U": rng.normal(0, width**-0.5, (width, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, width**-0.5, width),
            "d": np.array([np.log(share / (1 - share))]),
        }
        return Attention(x.mean(0), x.std(0) + 1e-3, p, share)

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, begin = self.p, np.cumsum(n) - n
        s = (x - self.mean) / self.scale
        h = np.tanh(s @ p["E"] + p["e"])
        t, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * u) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, begin), n))
        a /= np.repeat(np.add.reduceat(a, begin), n)
        z = np.add.reduceat(h * a[:, None], begin)
        out = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return out, s, h, t, u, a, z, begin

    def gradient(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p = self.p
        out, s, h, t, u, a, z, begin = self.forward(x, n)
        r = (out - y) / len(y)
        rows = np.repeat(r, n)
        dh = rows[:, None] * a[:, None] * p["c"]
        da = rows * (h @ p["c"])
        dl = a * (da - np.repeat(np.add.reduceat(a * da, begin), n))
        dt, du = dl[:, None] * u * p["w"] * (1 - t**2), dl[:, None] * t * p["w"] * u * (1 - u)
        dh = (dh + dt @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        g = {"E": s.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * u).T @ dl, "c": z.T @ r, "d": np.array([r.sum()])}
        return {k: v + decay * p[k] * (k not in "ed") for k, v in g.items()}

    def train(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        begin = np.cumsum(n) - n
        m, v, step = {k: 0.0 * q for k, q in self.p.items()}, {k: 0.0 * q for k, q in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                some = order[k: k + batch]
                rows = np.concatenate([np.arange(begin[q], begin[q] + n[q]) for q in some])
                g = self.gradient(x[rows], n[some], y[some], decay)
                step += 1
                for q in self.p:
                    m[q] = 0.9 * m[q] + 0.1 * g[q]
                    v[q] = 0.999 * v[q] + 0.001 * g[q] ** 2
                    self.p[q] = self.p[q] - rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)

    def forget(self) -> None:
        _forms.clear()

    def score(self, texts: list[str]) -> np.ndarray:
        got = [self.forward(x, n)[0] for x, n in bags(texts)]
        return np.concatenate(got) if got else np.zeros(0)


class Constant:
    def __init__(self, share: float):
        self.share = share

    def forget(self) -> None:
        pass

    def score(self, texts: list[str]) -> np.ndarray:
        return np.full(len(texts), self.share)


def fit(sample: DataFrame) -> Attention | Constant:
    """Fit on a sample of labelled texts; only their passages' features reach the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, n in bags(batch.column("text").to_pylist()):
                rows += [one.astype(np.float32).tobytes() for one in np.split(x, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("y")], ["doc_id", "x", "y"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "y").mapInArrow(extract, f"doc_id {kind}, x binary, y int").toPandas().sort_values("doc_id", kind="stable")
    y = rows["y"].to_numpy(float)
    share = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Constant(share)
    parts = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["x"]]
    n = np.array([len(p) for p in parts], np.int64)
    x = np.concatenate(parts).astype(float)
    model = Attention.begin(x, share)
    model.train(x, n, y)
    return model


def quality(docs: DataFrame, labels: DataFrame, most: int = 4_000, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels, "quality", most)), threshold)
