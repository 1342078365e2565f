"""Token counts by a compiled finite-state tokenizer.

A byte-pair-merge vocabulary is compiled, on demand, into a deterministic transducer over
characters. What a state has to remember of the text so far is small: which suffixes of it can
still grow into a longer piece, which token ended where each of these suffixes begins, and how many
tokens there were up to that place. A transition is annotated with the change of the number of
tokens that the text read so far encodes to, so the sum along the path is the count of tokens.

Texts are cut into chunks that run through the transducer side by side, one numpy step for each
character of the longest chunk. At a space that follows another character every state goes to the
same state with the same output, so the state map of a chunk beginning there is constant. Where no
such place is near, a chunk is cut anyway and its map is evaluated at the state that a short run-up
predicts. The maps are then composed by a parallel prefix scan, and evaluated at a further state
wherever the state arriving from the left is another one.

Empty and null texts have no tokens. Memory: the transition table is bounded and begun anew when
full; texts are taken in slices of a bounded number of characters, but one text is never split
between slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 0x2581
BARRIER = -1


class MergeVocabulary:
    """Pieces with priorities, and the answer to whether two tokens may stand side by side."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True):
        self.rank = pieces
        chars = sorted({c for p in pieces for c in p})
        self.tokens = list(pieces) + [c for c in chars if c not in pieces]
        self.cost = [1] * len(pieces) + [
            len(c.encode()) if byte_fallback else 1 for c in self.tokens[len(pieces):]
        ]
        self.fallback = byte_fallback
        self.chars = frozenset(map(ord, chars))
        self.inner = {(a, b) for p in pieces for a, b in zip(map(ord, p), map(ord, p[1:]), strict=False)}
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.parent: list[int] = [0]
        for n, p in enumerate(self.tokens):
            node = 0
            for c in map(ord, p):
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[node][c] = nxt
                    self.child.append({})
                    self.token_at.append(-1)
                    self.parent.append(node)
                node = nxt
            self.token_at[node] = n
        self.last_char = [ord(p[-1]) for p in self.tokens]
        self._pair: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> MergeVocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            n for n in range(sp.get_piece_size())
            if not (sp.is_byte(n) or sp.is_control(n) or sp.is_unknown(n) or sp.is_unused(n))
        ]
        fallback = any(sp.is_byte(n) for n in range(sp.get_piece_size()))
        return cls({sp.id_to_piece(n): sp.get_score(n) for n in plain}, fallback)

    def encode(self, text: str) -> list[str]:
        """Merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for n in range(len(parts) - 1):
                r = rank.get(parts[n] + parts[n + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, n
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def side_by_side(self, left: int, right: int) -> bool:
        if left == BARRIER:
            return True
        key = (left, right)
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) > 1_000_000:
                self._pair.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self._pair[key] = self.encode(a + b) == [a, b]
        return known


class Transducer:
    """States and transitions of one vocabulary, made as texts ask for them."""

    def __init__(self, vocabulary: MergeVocabulary, most: int = 1 << 21):
        self.vocabulary, self.most = vocabulary, most
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [(( 0, BARRIER, 0),)]
        self.number = {self.states[0]: 0}
        self.size, self.filled = 1 << 16, 0
        self._table()

    def _table(self) -> None:
        self.keys = np.full(self.size, -1, np.int64)
        self.next = np.zeros(self.size, np.int32)
        self.emit = np.zeros(self.size, np.int16)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (self.size.bit_length() - 1))).astype(np.int64)

    def _put(self, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        if (self.filled + len(key)) * 2 > self.size:
            held = self.keys >= 0
            old = self.keys[held], self.next[held], self.emit[held]
            while (self.filled + len(key)) * 2 > self.size:
                self.size *= 2
            self._table()
            self._fill(*old)
        self._fill(key, to, out)
        self.filled += len(key)

    def _fill(self, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        at = self._slot(key)
        rest = np.arange(len(key))
        while len(rest):
            free = rest[self.keys[at[rest]] == -1]
            self.keys[at[free]] = key[free]
            won = free[self.keys[at[free]] == key[free]]
            self.next[at[won]], self.emit[at[won]] = to[won], out[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            at[rest] = (at[rest] + 1) & (self.size - 1)

    def _make(self, state: int, char: int) -> tuple[int, int]:
        """The transition of one state and character: the state it leads to, and its output."""
        v = self.vocabulary
        if char not in v.chars:
            out = 1 if not v.fallback else 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            return self._state(((0, BARRIER, 0),)), out
        grown, token, count = [], -1, 0
        for node, last, ahead in self.states[state]:
            nxt = v.child[node].get(char)
            if nxt is None:
                continue
            if node == 0 and last != BARRIER and (v.last_char[last], char) not in v.inner:
                last = BARRIER
            t = v.token_at[nxt]
            if token < 0 and t >= 0 and v.side_by_side(last, t):
                token, count = t, ahead + v.cost[t]
            if v.child[nxt]:
                grown.append((nxt, last, ahead))
        new = tuple((n, t, a - count) for n, t, a in grown) + ((0, token, 0),)
        return self._state(new), count

    def _state(self, content: tuple) -> int:
        n = self.number.get(content)
        if n is None:
            n = self.number[content] = len(self.states)
            self.states.append(content)
        return n

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (state.astype(np.int64) << 21) | char
        at = self._slot(key)
        found = self.keys[at]
        off = np.flatnonzero(found != key)
        while len(off):
            empty = off[found[off] == -1]
            if len(empty):
                fresh = np.unique(key[empty])
                made = [self._make(int(k) >> 21, int(k) & 0x1FFFFF) for k in fresh]
                self._put(fresh, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
                at = self._slot(key)
                found = self.keys[at]
                off = np.flatnonzero(found != key)
                continue
            at[off] = (at[off] + 1) & (self.size - 1)
            found[off] = self.keys[at[off]]
            off = off[found[off] != key[off]]
        return self.next[at], self.emit[at]

    def run(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Evaluate the maps of chunks [begin, end) at one state each: their last states and counts."""
        order = np.argsort(begin - end, kind="stable")
        b, n, s = begin[order], (end - begin)[order], state[order].astype(np.int32)
        total = np.zeros(len(b), np.int64)
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), side="left")
        for k in range(longest):
            m = int(live[k])
            to, out = self.step(s[:m], chars[b[:m] + k])
            s[:m] = to
            total[:m] += out
        last, sums = np.empty_like(s), np.empty_like(total)
        last[order], sums[order] = s, total
        return last, sums

    def count(self, texts: list[str], near: int = 384, far: int = 1536, run_up: int = 48) -> np.ndarray:
        """The number of tokens of each text, spaces already marked, prefix included."""
        if self.filled > self.most:
            self._clear()
        length = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(length)
        starts = ends - length
        loose = np.zeros(len(chars) + 1, bool)
        loose[1:-1] = (chars[1:] == SPACE) & (chars[:-1] != SPACE)
        places = np.flatnonzero(loose)
        cut, tied = [], []
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            hard = False
            while a < z:
                cut.append(a)
                tied.append(hard)
                if z - a <= near:
                    break
                at = int(np.searchsorted(places, a + near))
                nxt = int(places[at]) if at < len(places) else z
                hard = nxt > a + far
                a = min(a + far if hard else nxt, z)
        begin, tied_to_left = np.array(cut, np.int64), np.array(tied, bool)
        if not len(begin):
            return np.zeros(len(texts), np.int64)
        owner = np.searchsorted(ends, begin, side="right")
        end = np.minimum(np.append(begin[1:], len(chars)), ends[owner])
        predicted = np.zeros(len(begin), np.int32)
        bound = np.flatnonzero(tied_to_left)
        if len(bound):
            predicted[bound] = self.run(chars, np.maximum(begin[bound] - run_up, starts[owner[bound]]), begin[bound], predicted[bound])[0]
        sums = self._compose(chars, begin, end, tied_to_left, predicted)
        head = ~tied_to_left
        owner = owner[head]
        result = np.zeros(len(texts), np.int64)
        np.add.at(result, owner, sums)
        return result


    def _compose(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, tied: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        """Counts of the runs of tied chunks, one for each chunk that is not tied to its left.

        The map of a chunk is a set of points (chunk, state before it) with the state after it and the
        count. Points are composed by a prefix scan: each is linked to the point of the next tied chunk
        at its last state, and links are doubled, adding counts, until they reach the run's end. Where a
        map has no such point yet, it is evaluated there, and the scan repeated."""
        more_follows = np.append(tied[1:], False)
        chunk, state = np.arange(len(begin)), predicted.astype(np.int64)
        last, count = self.run(chars, begin, end, predicted)
        while True:
            key = (chunk << 32) | state
            order = np.argsort(key)
            chunk, state, last, count, key = chunk[order], state[order], last[order], count[order], key[order]
            want = ((chunk + 1) << 32) | last.astype(np.int64)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            follows = more_follows[chunk]
            known = follows & (key[at] == want)
            # a last point of no count stands for the end of every run
            link = np.append(np.where(known, at, len(key)), len(key))
            total = np.append(count, 0)
            stop = np.append(np.where(follows & ~known, np.arange(len(key)), -1), -1)
            while (link < len(key)).any():
                total, stop, link = total + total[link], np.maximum(stop, stop[link]), link[link]
            head = np.searchsorted(key, np.flatnonzero(~tied) << 32)
            open_ends = np.unique(stop[head])  # points that some run's path stops at
            open_ends = open_ends[open_ends >= 0]
            if not len(open_ends):
                return total[head]
            fresh = np.unique(want[open_ends])
            new_chunk, new_state = fresh >> 32, fresh & 0xFFFFFFFF
            new_last, new_count = self.run(chars, begin[new_chunk], end[new_chunk], new_state.astype(np.int32))
            chunk, state = np.append(chunk, new_chunk), np.append(state, new_state)
            last, count = np.append(last, new_last), np.append(count, new_count)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(MergeVocabulary.from_sentencepiece(path))
    return _compiled[path]


def count_texts(texts: list[str], path: str, slice_chars: int = 3_000_000) -> np.ndarray:
    """Token counts of plain texts under a piece model with a leading space and no normalisation."""
    t, out, part, held = transducer(path), [], [], 0
    for text in texts:
        part.append(chr(SPACE) + text.replace(" ", chr(SPACE)) if text else "")
        held += len(text)
        if held >= slice_chars:
            out.append(t.count(part))
            part, held = [], 0
    out.append(t.count(part))
    return np.concatenate(out)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; null texts count as empty.

    The model's file is read on the executors by its path, so it has to be installed there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = count_texts(texts, model_path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
