"""Divergence of sources against plain Python integers."""

import random
import re
from collections import Counter

from cairnline.llm import divergence


def plain(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, words in mine:
            counts[s].update(w for w in words if df[w] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        each, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s, mine_p in each.items():
            pairs = [(-sum(f(mine_p[t], other[t]) for t in kept), o) for o, other in each.items() if o != s]
            terms = [(-f(mine_p[t], q[t]), t) for t in kept if counts[s][t] and mine_p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def compare(spark, rows, least=10, ranks=10):
    df = spark.createDataFrame([(k % 3, *r, "x", 1, "y", 2) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long, item string, rank int").repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(df, least, ranks).collect()) == plain(rows, least, ranks)


def test_odd_texts(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "ÉTÉ", "été", "日本", "x", "a1b", "don't", "😀"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""])) for _ in range(120)]
    compare(spark, [*rows, *rows[:30], (None, None, None), ("", "fr", "a"), ("lone word", "fr", "b"), ("\x00word\x00", "en", "a"), ("long " * 30_000, "en", "d")], 4, 3)


def test_more_sources_than_one_range(spark):
    rng = random.Random(2)
    compare(spark, [(" ".join(rng.choices("one two three four five six".split(), k=5)), "en", f"s{n:03}") for n in range(divergence.GROUPS + 20)])


def test_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
