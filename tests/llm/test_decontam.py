"""Decontamination: exact greedy tiles, and items told by their texts."""

import random

import numpy as np

from cairnline.llm import decontam
from conftest import prose  # noqa: F401  (tests/llm/conftest.py)


def greedy(item, text, least):
    """Again and again the longest common run of free words, the first in the item, then in the text."""
    mine, theirs, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and mine[a + n] and theirs[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        mine[a : a + n] = [False] * n
        theirs[b : b + n] = [False] * n
        tiles.append((a, b, n))


def test_tiles_are_greedy(monkeypatch):
    rng = random.Random(6)
    for k in range(1000):
        words = rng.choice([1, 2, 3, 6, 30])
        item = [rng.randrange(words) for _ in range(rng.randrange(24))]
        text = [rng.randrange(words) for _ in range(rng.randrange(40))]
        least = rng.choice([1, 2, 3, 5])
        if k == 500:
            monkeypatch.setattr(decontam, "MANY", 20)
        assert decontam.tile(np.array(item, np.uint64), np.array(text, np.uint64), least, rng.choice([2, 4, 24])) == greedy(item, text, least)


def test_texts_that_repeat_one_word():
    assert decontam.tile(np.zeros(500, np.uint64), np.zeros(200_000, np.uint64), 5) == [(0, 0, 500)]


def test_items_without_ids_and_with_shared_ids(spark, make):
    whole, seed = prose(30, 80), prose(60, 81)
    docs = make([(n, f"{prose(20, 90 + n)} {whole} x {' '.join(seed.split()[:5])}") for n in range(8)] + [(8, prose(50, 99))])
    for rows in ([(1, whole), (1, seed)], [(1, seed), (1, whole)]):
        found = decontam.report(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()
        assert sorted((r["doc_id"], r["item_id"], r["n_item"]) for r in found) == [(n, 1, 30) for n in range(8)]
    none = spark.createDataFrame([(None, whole), (None, None), (7, whole), (7, whole)], "item_id long, text string")
    found = decontam.report(docs, none).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in found) == [(n, i) for n in range(8) for i in (0, 7)]
    assert [r["doc_id"] for r in decontam.clean(docs, none).collect()] == [8]
