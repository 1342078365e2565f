"""N-gram join, decontamination, license scan, classifiers, pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cairnline.llm import decontam, learning, license_scan, ngram_join, quality, toxicity
from cairnline.llm.components import components
from cairnline.llm.wordhash import alnum_words
from conftest import prose  # noqa: F401  (tests/llm/conftest.py)


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[n: n + 5]) for n in range(max(1, len(w) - 4))} if w else set())
    return out


def classes(ids, texts):
    s, comp = sets(texts), {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(ids[a]), root(ids[b])))
                comp[y] = x
    return {i: root(i) for i in ids}


def copies(seed):
    rng = random.Random(seed)
    texts = []
    for n in range(12):
        base = prose(rng.choice((3, 5, 6, 20, 60, 150)), seed * 100 + n).split()
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(w))
    return texts + ["", None, "  ", "a b", "A  B", "a b c"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(make, seed):
    texts = copies(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    got = ngram_join.near_duplicates(make(list(zip(ids, texts, strict=True)))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(ids, texts)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in zip(ids, sets(texts), strict=True)}


def test_ngram_join_odd(odd, empty):
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in ngram_join.near_duplicates(odd).collect())
    assert got == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 1), (7, 1), (8, 8), (9, 9), (10, 10), (11, 11), (12, 12)]
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.one_of_each(odd)  # the row without id has the text of row 1
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 11, 12] and kept.columns == odd.columns


def test_one_of_each_goes_by_text(make):
    a, near, b, c = prose(40, 1), prose(40, 1) + " end", prose(40, 2), prose(40, 3)
    rows = [(5, a), (5, b), (3, near), (7, c), (7, prose(40, 4)), (None, c), (9, b), (9, b), (None, prose(40, 5)), (None, prose(40, 5))]
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        kept = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.one_of_each(make(mixed)).collect())
        assert kept == sorted([(3, near), (5, b), (7, c), (7, prose(40, 4)), (0, prose(40, 5))])


@pytest.mark.parametrize("chunk", [4, 512])
def test_links_of_a_large_group(make, chunk):
    """Many edits of one text: chunks and tiles, the numbers of links, and no row for a pair."""
    rng = random.Random(chunk)
    base, texts = prose(60, 3).split(), []
    for n in range(60):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(30)}"
        texts.append(" ".join(w))
    ids = list(range(100, 160))
    rows, classes_, members = ngram_join.linked_classes(make(list(zip(ids, texts, strict=True))), chunk=chunk)
    s, want = sets(texts), {}
    for a in range(60):
        want[ids[a]] = sum(100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) for b in range(60) if s[b] != s[a])
    got = {r["doc_id"]: r["links"] or 0 for r in rows.join(members, "set_key", "left").collect()}
    assert got == want
    named = {r["doc_id"]: r["component"] or r["set_key"] for r in rows.join(members, "set_key", "left").collect()}
    right = classes(ids, texts)
    assert len(set(named.values())) == len(set(right.values())) == len(set(zip(named.values(), (right[i] for i in named), strict=True)))


def test_families_chained_by_chance(make, monkeypatch):
    """Texts that share phrases with their neighbours, and don't link, leave a large family; near copies stay."""
    monkeypatch.setattr(ngram_join, "MOST_RANKED", 0)  # order by hash alone, as for shingles beyond the ranked ones
    tables, write = {}, ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: tables.setdefault(name, []).append(write(df, name)) or tables[name][-1])
    monkeypatch.setattr(ngram_join, "discard", lambda df: None)
    phrase = [[f"p{n}w{m}" for m in range(24)] for n in range(41)]
    texts = [" ".join(phrase[n] + [f"t{n}w{m}" for m in range(20)] + phrase[n + 1]) for n in range(40)]
    texts += [texts[n] + " end" for n in (0, 7, 20)] + [texts[3] + " one two", texts[3] + " three"]
    ids = list(range(len(texts)))
    rows, classes_, members = ngram_join.linked_classes(make(list(zip(ids, texts, strict=True))), chunk=4)
    named = {r["doc_id"]: r["component"] or r["set_key"] for r in rows.join(members, "set_key", "left").collect()}
    right = classes(ids, texts)
    assert len(set(named.values())) == len(set(right.values())) == len(set(zip(named.values(), (right[i] for i in named), strict=True)))
    assert tables["families"][0].count() > 20 and tables["able"][0].count() == 9
    assert tables["sizes"][0].agg({"chunks": "max"}).first()[0] > 4 and tables["sizes"][1].agg({"chunks": "max"}).first()[0] <= 3


def test_groups_chained_by_chance(make, monkeypatch):
    """Groups of near copies that only share phrases come apart, although each of their texts links with some other."""
    monkeypatch.setattr(ngram_join, "MOST_RANKED", 0)
    tables, write = {}, ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: tables.setdefault(name, []).append(write(df, name)) or tables[name][-1])
    monkeypatch.setattr(ngram_join, "discard", lambda df: None)
    phrase = [[f"p{n}w{m}" for m in range(24)] for n in range(13)]
    plain = [" ".join(phrase[n] + [f"t{n}w{m}" for m in range(60)] + phrase[n + 1]) for n in range(12)]
    texts = [t + end for t in plain for end in ("", " end", " one two")]
    ids = list(range(len(texts)))
    rows, classes_, members = ngram_join.linked_classes(make(list(zip(ids, texts, strict=True))), chunk=4)
    named = {r["doc_id"]: r["component"] or r["set_key"] for r in rows.join(members, "set_key", "left").collect()}
    right = classes(ids, texts)
    assert len(set(named.values())) == len(set(right.values())) == 12 == len(set(zip(named.values(), (right[i] for i in named), strict=True)))
    assert tables["families"][0].count() == tables["able"][0].count() == 36
    assert tables["sizes"][0].agg({"chunks": "max"}).first()[0] > 4 and tables["sizes"][-1].agg({"chunks": "max"}).first()[0] == 1


def test_components(spark):
    chain = [(n, n + 1) for n in range(60)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long").repartition(4)).collect()}
    assert {got[n] for n in range(61)} == {0} and got[101] == 100


def brute_tiles(item, text, least):
    free_a, free_b, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and free_a[a + n] and free_b[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return total
        n, a, b = best
        free_a[a: a + n] = [False] * n
        free_b[b: b + n] = [False] * n
        total += n


def test_tiles():
    rng = random.Random(5)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randint(0, 30))], np.uint64)
        text = np.array([rng.randrange(6) for _ in range(rng.randint(0, 60))], np.uint64)
        tiles = decontam.tile(item, text, 3)
        for a, b, n in tiles:
            assert n >= 3 and (item[a: a + n] == text[b: b + n]).all()
        for side in (0, 1):
            cells = [t[side] + k for t in tiles for k in range(t[2])]
            assert len(cells) == len(set(cells))
        assert sum(t[2] for t in tiles) >= 0.8 * brute_tiles(item.tolist(), text.tolist(), 3)
    for _ in range(60):  # every word once in the item: each match has one place, and greedy tiling one result
        item = np.array(rng.sample(range(100), rng.randint(1, 40)), np.uint64)
        cut = sorted(rng.sample(range(len(item) + 1), min(len(item), 3)))
        parts = np.split(item, cut) + [np.array([200 + k], np.uint64) for k in range(4)]
        rng.shuffle(parts)
        text = np.concatenate(parts)
        assert sum(t[2] for t in decontam.tile(item, text, 3)) == brute_tiles(item.tolist(), text.tolist(), 3)
    same = np.arange(80, dtype=np.uint64)
    assert decontam.tile(same, np.concatenate([same[40:], same[:40]]), 5) in ([(40, 0, 40), (0, 40, 40)], [(0, 40, 40), (40, 0, 40)])


def test_decontamination_with_a_seed_in_all_items(spark, make):
    """A run of words common to all items pairs no text with an item it holds too little of."""
    common = prose(6, 70)
    items = [f"{common} {prose(30, 71 + n)}" for n in range(20)]
    bench = spark.createDataFrame([(n, t) for n, t in enumerate(items)], "item_id long, text string")
    docs = make([(1, f"a {common} b"), (2, items[3]), (3, " ".join(items[4].split()[:20]))])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.report(docs, bench).collect()} == {(2, 3), (3, 4)}


def test_decontamination(spark, make, odd, empty):
    items = [prose(40, 50), prose(25, 51), "two words", "", None, prose(40, 50)]
    bench = spark.createDataFrame([(n, t, 1) for n, t in enumerate(items)], "item_id long, text string, key long")
    a, b = items[0].split(), items[1].split()
    docs = make([
        (1, "start " + items[0].upper().replace(" ", ", ") + " end"), (2, " ".join(a[20:] + ["x"] + a[:20])), (3, " ".join(a[:10])), (4, prose(100, 60)), (5, " ".join(b[:18]) + " other " + prose(50, 61)), (6, "has two words here"), (7, None),
    ])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.report(docs, bench).collect()}
    assert got == {(1, 0), (1, 5), (2, 0), (2, 5), (5, 1), (6, 2)}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [3, 4, 7]
    joined = {(r["doc_id"], r["item_id"]) for r in decontam.report(docs, bench, most_seeds=1).collect()}
    assert joined == got
    assert decontam.report(odd, bench).count() == 0 and decontam.clean(empty, bench).count() == 0 and decontam.report(docs, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench).columns == odd.columns


def test_license_votes_against_brute_force(make):
    """Notices with words changed, dropped and put in, near the threshold."""
    rng = random.Random(8)
    texts, want = [], []
    for n in range(60):
        label, notice = license_scan.TEMPLATES[n % len(license_scan.TEMPLATES)]
        w = notice.split()
        for _ in range(int(len(w) * rng.choice((0, 0.1, 0.2, 0.3, 0.4)))):
            at = rng.randrange(len(w))
            w[at: at + 1] = rng.choice(([], ["other"], [w[at], "more"]))
        w = prose(20, n).split() + w + prose(20, n + 99).split()
        texts.append(" ".join(w))
        found = {lab for lab, p in license_scan.PHRASES if f" {p} " in f" {' '.join(w)} "}
        for lab, t in license_scan.TEMPLATES:
            t = t.split()
            votes = {}
            for a in range(len(t) - 2):
                for b in range(len(w) - 2):
                    if t[a: a + 3] == w[b: b + 3]:
                        votes.setdefault(b - a, []).append(b)
            line = []
            for d in sorted(votes) + [10**9]:
                if line and d - line[-1] > 2:
                    begin, end = min(min(votes[x]) for x in line), max(max(votes[x]) for x in line) + 3
                    begin = max(0, min(begin, line[0]))
                    part, last = w[begin: max(end, begin + len(t) + 2)], [0] * (len(t) + 1)
                    for x in part:
                        row = [0]
                        for k, y in enumerate(t):
                            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
                        last = row
                    if last[-1] / len(t) >= 0.75:
                        found.add(lab)
                    line = []
                line.append(d)
        want.append(",".join(sorted(found)))
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(make(list(enumerate(texts)))).collect()}
    assert [got[n] for n in range(60)] == want and len(set(want)) > 10


def test_license_scan(make, odd, empty):
    texts = {
        1: "Code. Released under the MIT License. MIT License, under the MIT license!", 2: "licensed under the Apache-License, version 2", 3: "CC BY-NC 4.0", 4: "This work is licensed under the very GNU General Public License, version 3",
        5: "nothing here", 6: None, 7: "Redistribution and use in binary and source forms", 8: "under the mit",
    }
    got = {r["doc_id"]: r for r in license_scan.scan(make(list(texts.items()))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 2, 8, "mit")
    assert (got[2]["base_labels"], got[3]["base_labels"], got[3]["first_word"]) == ("apache-2", "cc-by-nc", 0)
    assert (got[4]["base_labels"], got[4]["labels"]) == ("", "gpl") and got[4]["score"] > 0.9
    assert [got[n]["labels"] for n in (5, 6, 7, 8)] == ["", "", "", ""] and got[6]["n_words"] == 0
    phrases = [(label, alnum_words(p.encode())) for label, p in license_scan.PHRASES]
    for n, t in texts.items():
        w = alnum_words((t or "").encode())
        at = sorted(k for _, p in phrases for k in range(len(w)) if w[k: k + len(p)] == p)
        assert (got[n]["n_words"], got[n]["n_base"], got[n]["first_word"], got[n]["last_word"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(8)
    docs, labels = [], []
    for n in range(700):
        words = prose(rng.randint(20, 200), n + 1).split()
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(("scum", "idiot", "vequ" + str(rng.randrange(99)))))
        if poor:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(9)]
        docs.append((n, " ".join(words)))
        labels.append((n, int(not poor), int(toxic), "x"))
    return make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("f, label, cut", [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_classifiers(labelled, odd, empty, f, label, cut):
    docs, labels = labelled
    rows = f(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = rows[rows.held_out]
    assert 90 < len(held) < 200 and learning.auc(held[label].to_numpy(), held.score.to_numpy()) > 0.95
    assert (rows.predicted == (rows.score >= cut)).all() and rows.score.between(0, 1).all()
    assert ((rows.predicted == rows[label])[rows.held_out]).mean() > 0.9
    for some in (odd, empty):
        assert f(some, labels).count() == some.count()
    none = f(docs.limit(5), labels.limit(0)).toPandas()
    assert len(none) == 5 and none.score.nunique() == 1


def test_isotonic_and_auc():
    m, y = np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 1, 0, 0, 1, 1])
    at, value = toxicity.isotonic(m, y, prior=0.0)
    assert (np.diff(value) >= 0).all() and np.interp([1, 2, 3], at, value) == pytest.approx([1 / 3] * 3)
    assert learning.auc(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])) == 0.75


def test_pipeline(spark, labelled, odd, tmp_path):
    docs, labels = labelled
    bench = spark.createDataFrame([(1, prose(40, 4000))], "item_id long, text string")
    more = odd.unionByName(docs.sparkSession.createDataFrame([(9001, prose(40, 4000), "en", "s", 1, "k", 5, "h", 1, 2, 3, "c", 0.5)], odd.schema))
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, stage, str(tmp_path))
        if n < 4:
            assert out.columns == stage.columns
            assert out.exceptAll(stage).count() == 0, name
        out.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
    assert stage.filter("doc_id = 9001").count() == 0 and stage.count() > 300
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stage.count()


def test_packing_loads_the_library_only_when_a_text_needs_it():
    from cairnline.llm.packing import WordEncoder
    from cairnline.llm.queries import byte_tokenizer

    enc = WordEncoder(*byte_tokenizer())
    plain = enc.encode("plain words only")
    assert "library" not in enc.__dict__
    enc.encode("กข odd letters")
    assert "library" in enc.__dict__ and plain == np.array(enc.library.encode("plain words only", add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_encodes_a_text_of_new_words_at_once():
    """Every word not yet remembered was a call of its own."""
    from cairnline.llm.packing import WordEncoder
    from cairnline.llm.queries import byte_tokenizer

    enc, calls = WordEncoder(*byte_tokenizer()), []

    class Counted:
        def encode_ordinary(self, text, inner=enc.encoding):
            calls.append(text)
            return inner.encode_ordinary(text)

    enc.encoding = Counted()
    text = " ".join(f"w{n:x}q{n * 7919 % 1013}," for n in range(3000)) + " two  spaces\nand a line "
    assert enc.encode(text) == np.array(enc.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(calls) == 1
