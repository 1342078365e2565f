"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items that share a run of ``least`` words are joined. For each such pair the
longest unmarked common runs of words are found by Karp-Rabin hashing, marked, and searched again
with shorter lengths down to ``least``; the marked tiles never overlap, and they may stand in any
order in the text, so reordered passages are caught too. A pair whose tiles cover at least
``coverage`` of the item's words is reported.

Runs of the items (a table whose size is checked) are looked up where the texts are hashed; beyond
``most_seeds`` runs they are joined instead. Only texts with a shared run travel further, once for
equal texts.

Items are told by their texts, never by their ids: ids are joined last, so an item without an id counts
like any other, and items that share an id are matched one by one.

Defined results: null and empty texts or items match nothing; an item under ``least`` words is matched
as one run of all its words; items of one text are reported by each of their ids, once for each; a null id is
reported as null, and different items of one id as rows of that id; equal texts alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, slices
from .wordhash import MIX, alnum_words, mixed, runs, split_hashes, word_hashes


#: Most text digests that are broadcast; beyond it they are joined by shuffling.
MOST_BROADCAST = 500_000


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` numbers, by doubling: a run of length 2n is a run
    of length n, shifted, plus another."""
    if len(h) < size or size < 1:
        return np.zeros(0, np.uint64)
    out, have, power = np.zeros(len(h) - size + 1, np.uint64), 0, h
    base, width = np.array([MIX | np.uint64(1)]), 1
    while size:
        if size & 1:
            out = out * base + power[have: have + len(out)]
            have += width
        size >>= 1
        if size:
            power = power[: len(power) - width] * base + power[width:]
            base, width = base * base, width * 2
    return mixed(out)


#: Places of one search beyond which longer runs are searched first, as in texts that repeat themselves.
MANY = 4_000_000


def tile(item: np.ndarray, text: np.ndarray, least: int, first: int = 24) -> list[tuple[int, int, int]]:
    """Tiles (begin in item, begin in text, length): again and again the longest common run of unmarked
    words (of equals that begins first in the item, then in the text), until none has ``least``.

    Runs of at least ``size`` words are searched for, then shorter ones. Marking only shortens runs, so what
    is left of a run that is partly taken goes back into the order of lengths, and when the order is empty no
    run of that size is left."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    above = min(len(item), len(text)) + 1  # no run of that many words is left
    size = max(least, min(first, above - 1))
    while above > least:
        found = _common(item, text, free_item, free_text, size, MANY if size + 1 < above else None)
        if found is None:
            size = min(2 * size, above - 1)
            continue
        heapq.heapify(found)
        while found:
            n, a, b = heapq.heappop(found)
            n = -n
            taken = np.flatnonzero(~(free_item[a : a + n] & free_text[b : b + n] & (item[a : a + n] == text[b : b + n])))
            if not len(taken):
                free_item[a : a + n] = False
                free_text[b : b + n] = False
                tiles.append((a, b, n))
                continue
            for low, high in zip([-1, *taken.tolist()], [*taken.tolist(), n], strict=True):
                if high - low - 1 >= size:
                    heapq.heappush(found, (low + 1 - high, a + low + 1, b + low + 1))
        above, size = size, max(least, size // 2)
    return tiles


def _common(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, size: int, most: int | None) -> list[tuple[int, int, int]] | None:
    """Longest unmarked common runs of at least ``size`` words as (-length, begin in item, begin in text); None
    if more than ``most`` places match."""
    def open_runs(h: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = windows(h, size)
        taken = np.concatenate([[0], np.cumsum(~free)])
        ok = taken[size:] == taken[: len(taken) - size] if len(free) >= size else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        return at, w[at]

    at_item, w_item = open_runs(item, free_item)
    at_text, w_text = open_runs(text, free_text)
    if not len(at_item) or not len(at_text):
        return []
    order = np.argsort(w_item, kind="stable")
    low, high = np.searchsorted(w_item[order], w_text), np.searchsorted(w_item[order], w_text, side="right")
    many = high - low
    total = int(many.sum())
    if most is not None and total > most:
        return None
    b = np.repeat(at_text, many)
    a = at_item[order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)]]
    # places that follow each other on one diagonal are one run
    along = np.lexsort((a, b - a))
    a, b = a[along], b[along]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])) if total else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, total)) + size - 1
    return list(zip((-lengths).tolist(), a[begins].tolist(), b[begins].tolist(), strict=True))


def contaminated(
    docs: DataFrame, items: DataFrame, least: int = 5, coverage: float = 0.5, most_seeds: int = 2_000_000,
) -> DataFrame:
    """Reported pairs of text and item: ``key, item_id, coverage, tiles, longest, n_item``; ``key``
    is the text's digest."""
    spark = docs.sparkSession
    named = items.select("item_id", text_key().alias("item_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("item"))
    whole = materialise(named.groupBy("item_key").agg(F.first("item").alias("item")), "items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = split_hashes([alnum_words(t) for t in batch.column("item").to_pylist()], word_hashes)
            at, seed, places = [], [], []
            for n, h in enumerate(each):
                r, many = np.unique(runs(h, min(least, len(h)) or 1).view(np.int64), return_counts=True)
                at += [n] * len(r)
                seed += r.tolist()
                places += many.tolist()
            sizes = pa.array([len(h) for h in each], pa.int32())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_key").take(take), sizes.take(take), pa.array(seed, pa.int64()), pa.array(places, pa.int64())], ["item_key", "n_item", "seed", "places"])

    seeds = materialise(whole.mapInArrow(item_seeds, "item_key string, n_item int, seed long, places long"), "seeds")
    counts = {r["n_item"]: r["n"] for r in seeds.filter(f"n_item < {least}").groupBy("n_item").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = sorted(int(n) for n in counts if n)
    small = seeds.select("seed").distinct().limit(most_seeds + 1).count() <= most_seeds
    known = np.sort(seeds.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)) if small else None
    known = spark.sparkContext.broadcast(known)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found, at = [], []
            for n, h in enumerate(split_hashes([alnum_words(t) for t in texts], word_hashes)):
                r = np.unique(np.concatenate([runs(h, n).view(np.int64) for n in (*short, least)]))
                if known.value is not None:
                    r = r[np.isin(r, known.value, assume_unique=True)]
                if len(r):
                    at.append(n)
                    found.append(r.tolist())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), pa.array(found, pa.list_(pa.int64())), pa.array([texts[n] for n in at], pa.binary())], ["key", "seeds", "text"]
            )

    seeded = docs.select(text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seeded = seeded.mapInArrow(hashed, "key string, seeds array<long>, text binary")
    seeded = materialise(seeded.groupBy("key").agg(F.first("seeds").alias("seeds"), F.first("text").alias("text")), "seeded")
    # A tile of n words begins or goes through n - least + 1 places of the item where a seed stands, so
    # tiles of the coverage asked for need a share of such places. Texts and items meet on the item's rarest seeds:
    # those without which fewer places are left than are needed. A seed of every text is the last of them.
    need = F.ceil(F.ceil(F.lit(coverage) * F.col("n_item")) / least)
    often = seeded.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    left = F.sum("places").over(Window.partitionBy("item_key").orderBy(F.desc("often"), "seed"))
    rare = seeds.join(often, "seed").withColumn("left", left).filter(F.col("left") >= need).select("item_key", "seed")
    pairs = seeded.select("key", F.explode("seeds").alias("seed")).join(rare, "seed").select("key", "item_key").distinct()
    bag = seeds.groupBy("item_key").agg(F.first("n_item").alias("n_item"), F.collect_list(F.struct("seed", "places")).alias("bag"))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose shared places can make the coverage; others end here, before texts move."""
        for batch in batches:
            good = []
            for n, item, mine in zip(batch.column("n_item").to_pylist(), batch.column("bag"), batch.column("seeds"), strict=True):
                seed, places = (item.values.field(c).to_numpy() for c in ("seed", "places"))
                good.append(int(places[np.isin(seed, mine.values.to_numpy())].sum()) * least >= np.ceil(coverage * n))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("key", "item_key")], ["key", "item_key"])

    met = pairs.join(bag, "item_key").join(seeded.select("key", "seeds"), "key").select("key", "item_key", "n_item", "bag", "seeds")
    wanted = met.mapInArrow(enough, "key string, item_key string").join(whole, "item_key").join(seeded.select("key", "text"), "key")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows, at = [], []
            texts = split_hashes([alnum_words(t) for t in batch.column("text").to_pylist()], word_hashes)
            each = split_hashes([alnum_words(t) for t in batch.column("item").to_pylist()], word_hashes)
            for n, (h, q) in enumerate(zip(texts, each, strict=True)):
                tiles = tile(q, h, max(1, min(least, len(q))))
                share = sum(t[2] for t in tiles) / max(1, len(q))
                if share >= coverage:
                    at.append(n)
                    rows.append((share, len(tiles), max(t[2] for t in tiles), len(q)))
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), batch.column("item_key").take(take), *columns], ["key", "item_key", "coverage", "tiles", "longest", "n_item"]
            )

    found = materialise(wanted.mapInArrow(tiled, "key string, item_key string, coverage double, tiles int, longest int, n_item int"), "tiles")
    for table in (seeded, seeds, whole):
        discard(table)
    return found.join(named.select("item_id", "item_key").distinct(), "item_key").select("key", "item_id", "coverage", "tiles", "longest", "n_item")


def text_key() -> Column:
    """A digest of the text; null counts as empty."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``doc_id, item_id, coverage, tiles, longest, n_item``: a row for each contaminated row of
    ``docs`` and item found in it. Clean rows have none."""
    found = contaminated(docs, items, **how)
    return docs.select("doc_id", text_key().alias("key")).join(found, "key").drop("key")


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, whole, in which no item is found."""
    found_key = "_found_text"
    while found_key in docs.columns:
        found_key += "_"
    found = contaminated(docs, items, **how).select(F.col("key").alias(found_key)).distinct()
    found = found if found.count() > MOST_BROADCAST else F.broadcast(found)
    return docs.join(found, text_key() == F.col(found_key), "left_anti")
