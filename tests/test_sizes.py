"""What findings of round 3 on larger tables were about: work and memory that follow the input's size."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnline.operators import clusters as C
from cairnline.operators import evaluate, graph, placement
from cairnline.operators.catalog import ENZYMES
from cairnline.operators.components import connected_components
from cairnline.operators.digest import LANDMARKS, by_size, digest, digest_native
from cairnline.sources import streams


def letters(n, seed=1):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_batches_are_cut_by_bytes():
    texts = ["A" * n for n in (5, 5, 30, 0, 3, 3, 3)] + [None, "A"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["n", "seq"])
    cut = list(by_size(iter([batch, batch.slice(2, 4)]), "seq", 10))
    assert [b.num_rows for b in cut] == [2, 1, 6, 1, 3]
    assert [x for b in cut[:3] for x in b.column("n").to_pylist()] == list(range(9))


def test_native_search_is_one_pass(spark):
    """One sequence of 400,000 letters: a search that reads it anew from every place does not end."""
    hit = "A" * 10 + "CGA" + "C" * 6 + "TGC" + "G" * 10
    seqs = [letters(400_000), hit, hit + hit, "T" + hit, hit[:-1], "", (hit[:10] + "CGA") * 9, letters(33, 5)]
    c = spark.createDataFrame([("g", n, s) for n, s in enumerate(seqs)], "genome string, contig_id long, seq string")
    key = ["contig_id", "pos", "seq", "strand"]
    for name in ("BcgI", "HaeIV", "CspCI"):
        want = sorted(map(tuple, digest(c, [ENZYMES[name]]).select(*key).collect()))
        assert sorted(map(tuple, digest_native(c, ENZYMES[name]).select(*key).collect())) == want
        assert len(want) > 10 or name == "CspCI" and want or name == "BcgI"


def test_pairs_that_share_two_keys(spark):
    """Long sets, which meet on single keys, and short ones, which meet on pairs of keys, give the same pairs."""
    r = random.Random(3)
    sets = {o: {r.randrange(40) for _ in range(r.randrange(1, 12))} for o in range(1, 61)}
    df = spark.createDataFrame([(o, k) for o, ks in sets.items() for k in [*ks, *ks]], "o long, k long")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    for most in (40, 6, 1):
        got = [tuple(x) for x in C.sharing_two(df, "o", "k", most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_seeded_targets_are_counted_over_blocks(spark):
    items = C.with_tokens(C.synthetic_features(spark, 120, 4).withColumn("ko", F.concat(F.lit("K"), F.pmod(F.xxhash64("gene_id"), F.lit(30)).cast("string"))))
    items = items.withColumn("cluster", F.col("cluster_id"))
    mine = items.filter(F.pmod(F.xxhash64("cluster"), F.lit(5)) == 0)
    t = C.token_counts(items)
    want = {r[0]: r[1] for r in C.seeds(C.token_counts(mine), t, C.adjacencies(mine), C.adjacencies(items), 3.0).groupBy("q").count().collect()}
    keys = C.seed_keys(items, 3.0)
    for rows in ((1000, 1000), (20, 90)):
        got = C.seed_counts(C.seed_keys(mine, 3.0), keys, *rows).collect()
        assert len(got) == len(want) and {r[0]: r[1] for r in got} == want


def test_seeds_of_all_clusters(spark, monkeypatch):
    """Every cluster is a query, also of the registered one; frequent and rare keys, short and long clusters."""
    from cairnline.plans.table_queries import cluster_seeds

    items = C.with_tokens(C.synthetic_features(spark, 120, 4).withColumn("ko", F.concat(F.lit("K"), F.pmod(F.xxhash64("gene_id"), F.lit(60)).cast("string"))))
    keys = C.seed_keys(items.withColumn("cluster", F.col("cluster_id")), 3.0).localCheckpoint()
    k = {}
    for c, key in keys.collect():
        k.setdefault(c, set()).add(key)
    want = {c: sum(not k[c].isdisjoint(x) for x in k.values()) for c in k}
    for frequent, many, most in ((200, 8, 40), (6, 8, 40), (6, 3, 40), (6, 8, 6), (1, 8, 40)):
        monkeypatch.setattr(C, "FREQUENT_KEYS", many)
        monkeypatch.setattr(C, "KEYS", most)
        got = C.seed_totals(keys, frequent, 50).collect()
        assert len(got) == len(want) and {r[0]: r[1] for r in got} == want
    got = {r["q"] for r in cluster_seeds(spark, "/root/testdata/sf0.001").collect()}
    orders = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert len(got) > 0.9 * len(orders) and sum(int(q.split(":o")[1]) % 50 > 0 for q in got) > 0.9 * len(got)


def test_links_connect_what_pairs_connect(spark):
    r = random.Random(7)
    seqs = {"".join(r.choices("ACG", k=k)) for k in (3, 4, 5, 6, 27) for _ in range(1, 61)}
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    links = {tuple(x) for x in graph.near_links(df).collect()}
    pairs = {tuple(x) for x in graph.near_pairs(df, 1).collect()}
    named = lambda e: {tuple(x) for x in connected_components(spark.createDataFrame(sorted(e), "a string, b string")).collect()}
    assert links <= pairs and len(links) < len(pairs) and named(links) == named(pairs)


def test_cosines_above_a_threshold(spark, monkeypatch):
    """Packed pairs, with and without pieces of frequent terms, give the cosines of all pairs that reach the threshold."""
    r = random.Random(6)
    rows = [(d, t) for d in range(1, 61) for t in {r.choice((r.randrange(4), r.randrange(60))) for _ in range(r.randrange(1, 15))}]
    df = spark.createDataFrame([*rows, *rows[:40], (99, None)], "d int, t int")
    plain = {(a, b): c for a, b, c in evaluate.cosine_pairs(df, "d", "t").collect()}
    for piece, pairs in ((4096, 3_000_000), (7, 100)):
        monkeypatch.setattr(evaluate, "PIECE", piece)
        monkeypatch.setattr(evaluate, "BLOCK_PAIRS", pairs)
        for least in (0.1, 0.4):
            got = [tuple(x) for x in evaluate.cosine_above(df, "d", "t", least).collect()]
            assert len(got) == len({x[:2] for x in got}) and {x[:2] for x in got} == {k for k, c in plain.items() if c >= least}
            assert all(abs(c - plain[a, b]) < 1e-9 for a, b, c in got)
    a, b, w = np.array([1, 1, 5, 2**40]), np.array([3, 9, 7, 2**41]), np.array([0.5, 0.1, 1e-7, 1.0], "<f2")
    assert all((x == y).all() for x, y in zip(evaluate._unpacked(evaluate._packed(a, b, w)), (a, b, w), strict=True))


def test_medians_of_frequent_letters(spark, monkeypatch):
    """A list that travels is as long as there are ranges, or a range's part of a letter's places."""
    written, write = {}, placement.materialise
    monkeypatch.setattr(placement, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    r = random.Random(8)
    places = {(s, g): sorted(r.sample(range(100_000), n)) for s, n in (("often", 3000), ("some", 40), ("once", 1)) for g in "xyz"}
    lists = spark.createDataFrame([(s, g, p) for (s, g), p in places.items()], "seq string, _other string, places array<bigint>")
    rows, want = [], {}
    for n in range(30):
        g, own = "xyz"[n % 3], {s: r.randrange(1, 4) for s in r.sample(["often", "some", "once"], r.randrange(1, 4))}
        all_ = sorted(p for s, k in own.items() for o in "xyz" if o != g for p in places[s, o] for _ in range(k))
        rows += [(g, n, s, k, len(all_)) for s, k in own.items()]
        want[g, n] = all_[len(all_) // 2]
    hits = spark.createDataFrame(rows, "genome string, contig_id bigint, seq string, k bigint, shared bigint")
    got = placement.medians(hits, lists, ["genome", "contig_id"], ["genome"], 20, 16).collect()
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want
    assert written["ranges"].agg(F.max(F.size("places"))).first()[0] < 400


def test_tolerant_tags_go_by_numbers(spark, monkeypatch):
    """Links and components move numbers; pairs of letters that have no other near them are done before the rounds."""
    from cairnline.operators import components

    written, write = {}, components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.setdefault(name, []).append(write(df, name)) or written[name][-1])
    r = random.Random(4)
    seqs = sorted({"".join(r.choices("ACG", k=k)) for k in (2, 3, 5, 6, 28) for _ in range(1, 41)})
    rows = [(g, s) for s in seqs for g in r.sample("xyz", r.choice((1, 2, 3, 3)))]
    marks = spark.createDataFrame(rows + rows[:50], "genome string, seq string")
    for distance in (1, 2):
        group = {s: s for s in seqs}
        near = [(a, b) for a in seqs for b in seqs if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= distance]
        before = None
        while before != group:
            before = dict(group)
            for a, b in near:
                group[a] = min(group[a], group[b])
        want = {(c, sum(v == c for v in group.values())) for c in set(group.values()) if len({g for g, s in rows if group[s] == c}) == 3}
        got = [tuple(x) for x in graph.tolerant_tags(marks, distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert written["links"][0].dtypes == [("u", "bigint"), ("v", "bigint")]
    written.clear()
    two = connected_components(spark.createDataFrame([(n, n + 1) for n in range(0, 40, 2)], "a long, b long"))
    assert sorted(map(tuple, two.collect())) == sorted((n, n - n % 2) for n in range(40)) and written["stars"][1].count() == 0


def test_near_letters_meet_on_long_keys(spark):
    """Letters that all agree in one quarter: on single quarters every pair would meet, and nothing else tells how many rows met."""
    r = random.Random(8)
    seqs = sorted({"".join(r.choices("ACGT", k=10)) + "CGA" + "".join(r.choices("ACGT", k=6)) + "TGC" + "".join(r.choices("ACGT", k=10)) for _ in range(300)})
    seqs += [s[:4] + s[5:8] + "AA" + s[9:] for s in seqs[:40]] + ["T" + s[1:31] + "T" for s in seqs[:40]]
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    got = {tuple(x) for x in graph.near_pairs(spark.createDataFrame([(s,) for s in set(seqs)], "seq string"), 3).collect()}
    assert got == {(a, b) for a in set(seqs) for b in set(seqs) if a < b and len(a) == len(b) and apart(a, b) <= 3}


def test_lcs_of_orders_that_share_two_parts(spark, tmp_path):
    """The registered query called the step for its pairs without the tables and failed."""
    from cairnline.plans.registry import QUERIES
    from cairnline.plans import table_queries  # noqa: F401

    orders = {1: [1, 2, 3, 4], 2: [4, 1, 2], 3: [1], 4: [5, 4, 3]}
    lines = [(o, n, p, 1) for o, ps in orders.items() for n, p in enumerate(ps, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(p, "STANDARD", f"Brand#{p}", p, f"part {p}") for p in range(1, 6)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, QUERIES["lcs_lengths"](spark, str(tmp_path)).collect()))
    assert got == [("s1:o1", "s2:o2", 2), ("s1:o1", "s4:o4", 1)]


def marks(spark, n=900, kinds=40, seed=5):
    """One series holds most landmarks; contigs of very different sizes."""
    r = random.Random(seed)
    rows = [("big" if r.random() < 0.8 else r.choice("xyz"), r.choice([1, 2, 2, 2, 3, 7]), k, k * 10, "s%02d" % r.randrange(kinds), "e", "+") for k in range(n)]
    return spark.createDataFrame([(*x, x[3]) for x in rows], "genome string, contig_id long, ord long, pos long, seq string, enzyme string, strand string, gpos long")


def test_weights_are_those_of_edges(spark):
    m = marks(spark)
    want = {tuple(x) for x in graph.edges(m).select("src", "tgt", "weight").collect()}
    assert {tuple(x) for x in graph.weights(m).collect()} == want
    assert {tuple(x) for x in graph.weights(m, 2).collect()} == {x for x in want if x[2] >= 2} != set()


def test_paths_are_ranked_on_numbers(spark, monkeypatch):
    """Rounds carried seven letter sequences a row."""
    written, inner = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (written.append((name, {f.dataType.simpleString() for f in df.schema})), inner(df, name))[1])
    e = [("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("q", "p"), ("p", "r"), ("r", "q")]
    steps = graph.path_steps(spark.createDataFrame(e, "src string, tgt string"))
    got = {}
    for p, k, s, n in steps.collect():
        got.setdefault((p, n), {})[k] = s
    assert {(p, n, "".join(v[k] for k in range(n))) for (p, n), v in got.items()} == {("a>b", 4, "abcd"), ("d>e", 2, "de"), ("d>f", 2, "df"), ("p>q", 3, "pqr")}
    rounds = [kinds for name, kinds in written if name == "arcs"]
    assert len(rounds) > 2 and all(k <= {"bigint"} for k in rounds)


def test_ranks_of_a_series_are_counted_in_ranges(spark, monkeypatch):
    """One window sorted a whole series in one task."""
    from cairnline.operators import ranges, structure

    cut, inner = [], ranges.ranged
    monkeypatch.setattr(ranges, "ranged", lambda *a: (cut.append(a[1:3]), inner(*a))[1])
    m = marks(spark)
    at, places = {}, {}
    for g, c, o, s in sorted(map(tuple, m.select("genome", "contig_id", "ord", "seq").collect())):
        at[g] = at.get(g, 0) + 1
        places.setdefault((g, s), []).append(at[g])
    want = sorted((a, b, max(x), y) for (a, s), x in places.items() for (b, t), ys in places.items() if s == t and a < b for y in ys)
    assert sorted(map(tuple, structure._ranks(m, 7).collect())) == want and cut == [(["genome"], ["contig_id", "ord"])]


@pytest.mark.parametrize("key", ["genome", None])
def test_medians_without_matches_as_rows(spark, monkeypatch, key):
    """Contigs stand where the sorted list of all their matches has its upper middle, and the
    tables between the steps are far smaller than the matches."""
    rng = np.random.default_rng(7)
    kinds = ["AAAC", "AACC", "ACCC", "GGTA", "GTTT", "GGGT"]
    rows = [(f"g{n % 3}", n // 20, n, int(p), "AAAC" if n % 2 else kinds[int(rng.integers(6))], "BcgI", "+", int(p)) for n, p in enumerate(rng.integers(0, 5000, 1200))]
    rows = [r for r in rows if key or r[0] == "g0"]
    m = spark.createDataFrame(rows, LANDMARKS + ", gpos long")
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {}
    for g, c in {(r[0], r[1]) for r in rows}:
        mine = [r[4] for r in rows if (r[0], r[1]) == (g, c)]
        ahead, back = (sorted(r[7] for s in mine for r in rows if r[4] == way(s) and (not key or r[0] != g)) for way in (str, turn))
        flip = len(back) > 2 * len(ahead)
        here = back if flip else ahead
        if len(here) >= 2:
            want[g, c] = (flip, len(here), here[len(here) // 2])
    between, cut = [], placement.materialise
    monkeypatch.setattr(placement, "materialise", lambda df, name: (lambda d: between.append(d.count()) or d)(cut(df, name)))
    size = m.select("genome", "contig_id").distinct().withColumn("length", F.lit(10).cast("long"))
    got = placement.scaffold(m, m, size if key else size.drop("genome"), 2, key=key).collect()
    assert {((r["genome"] if key else "g0"), r["contig_id"]): (r["reverse"], r["shared"], r["median_ref"]) for r in got} == want
    assert between and 10 * sum(between) < sum(w[1] for w in want.values())


def test_met_pairs_follow_tasks_and_not_blocks(spark, monkeypatch):
    """One task meets 20 blocks of targets. What an earlier block found bars worse targets of later ones, and packed
    blocks, not postings, are copied."""
    rows = [(f"c{n:03d}", "AB" if n < 5 else "ABCDEFG"[: 2 + n % 6]) for n in range(200)]
    p = spark.createDataFrame([(c, C.TOKEN, k, 1, 3.0) for c, ks in rows for k in ks] + [(c, C.REP, k, 1, 0.0) for c, ks in rows for k in ks], "cluster string, kind int, key string, n long, w double")
    sizes, cut = {}, C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: (lambda d: sizes.__setitem__(name, d.count()) or d)(cut(df, name)))
    monkeypatch.setattr(C, "CELL_TASKS", 1)
    mine = p.filter("cluster < 'c005'")
    whole = {(r["q"], r["t"]) for r in C.meet(mine, p, 0.2, 0.0, 2, 2.0, rows=5_000).collect()}
    alone = sizes["met"]
    parts = {(r["q"], r["t"]) for r in C.meet(mine, p, 0.2, 0.0, 2, 2.0, rows=100).collect()}
    assert parts == whole and len(whole) >= 10
    assert sizes["target-blocks"] >= 15 and sizes["met"] < 3 * alone


def test_small_files_share_tasks(spark, tmp_path):
    """Many small files are read by a few tasks, each file once."""
    for n in range(1, 61):
        (tmp_path / f"f{n}").write_bytes(b"x" * n)
    read = streams.each_file(spark, f"file://{tmp_path}", lambda name, stream: iter([{"file": [name.rsplit("/", 1)[-1]], "n": [len(stream.read())]}]), "file string, n long")
    assert sorted((r["file"], r["n"]) for r in read.collect()) == sorted((f"f{n}", n) for n in range(1, 61))
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 60


def test_parts_of_an_index_are_bounded(spark, tmp_path):
    """One task sorts a part, so parts follow the landmarks' number before a task is large."""
    assert placement.PART_ROWS <= 500_000
    m = spark.range(2000).select(F.lit("g").alias("genome"), F.lit(1).cast("long").alias("contig_id"), "id", F.lit("HaeIV").alias("enzyme"), F.lit("+").alias("strand"), F.conv(F.col("id").cast("string"), 10, 4).alias("n"))
    m = m.select("genome", "contig_id", F.col("id").alias("ord"), (F.col("id") * 40).alias("gpos"), F.translate("n", "0123", "ACGT").alias("seq"), "enzyme", "strand")
    old, placement.PART_ROWS = placement.PART_ROWS, 100
    try:
        placement.keep_index(m, str(tmp_path))
    finally:
        placement.PART_ROWS = old
    index = placement.open_index(spark, str(tmp_path))
    assert index.parts == 20 and index.tags.count() == 2000


def plain_chain(r, ahead):
    """Longest strictly rising or falling chain; the earliest predecessor and the earliest end win."""
    score, before = [], []
    for k, x in enumerate(r):
        fits = [j for j in range(k) if (r[j] < x if ahead else r[j] > x)]
        best = min(fits, key=lambda j: (-score[j], j), default=None)
        score.append(1 + (score[best] if best is not None else 0))
        before.append(best)
    at, out = score.index(max(score)), []
    while at is not None:
        out.append(at)
        at = before[at]
    return out


@pytest.mark.parametrize("ahead", [True, False])
def test_many_chains_at_once(ahead):
    """Chains of several queries and series are found in one pass, one step of all of them after another."""
    rng = np.random.default_rng(5)
    rows = sorted((int(s), i, int(v)) for i in range(7) for s, v in zip(rng.integers(0, 9, 30 * i + 1), rng.integers(0, 40, 30 * i + 1), strict=True))
    step, inst, value = (np.array(c) for c in zip(*rows, strict=True))
    got = placement.chains(inst, step, value, ahead)
    for i in range(7):
        mine = np.flatnonzero(inst == i)
        assert got[inst[got] == i].tolist() == [mine[k] for k in plain_chain(value[mine].tolist(), ahead)]


def copied(spark, contigs=40, kinds=12):
    """Contigs of two series that share most landmarks: some in order, some turned, one landmark repeated."""
    rows, rng = [], random.Random(3)
    words = sorted(letters(8, 100 + n) for n in range(kinds))
    for c in range(contigs):
        order = rng.sample(words, kinds - 3)
        order = sorted(order, reverse=c % 3 == 1) if c % 3 else order
        order += order[:1] if c % 5 == 0 else []
        rows += [(f"g{c % 2}", c, n, 50 * n, w, "X", "+", c * 10_000 + 50 * n) for n, w in enumerate(order)]
    return spark.createDataFrame(rows, LANDMARKS + ", gpos long")


def test_matches_of_frequent_landmarks_are_not_rows(spark, monkeypatch):
    m = copied(spark)
    queries, index = placement.query_landmarks(m), placement.as_index(placement.build_index(m))
    pairs = placement.query_pairs(queries, index.kinds)
    chosen = placement.candidates(queries, pairs, index.kinds, index.pair_kinds, 3, 0, False, True)
    met = placement.anchors(queries, chosen, index.tags)
    assert "Window" not in met._jdf.queryExecution().optimizedPlan().toString()  # it shuffled and sorted every match
    matches, support = {}, {}
    for r in met.collect():
        matches.setdefault((r["q"], r["genome"]), []).append((r["qpos"], r["rpos"], r["canon"], r["contig_id"]))
    known = [tuple(r) for r in index.pairs.select("a", "b", "genome", "x", "y").collect()]
    for q, x, y in pairs.select("q", "x", "y").collect():
        for a, b, genome, px, py in known:
            if (a, b) == (min(x, y), max(x, y)):
                support.setdefault((q, genome), []).append((a, b, (px, py) == (x, y)))
    want = set()
    for key, rows in matches.items():
        rows.sort()
        best = None
        for ahead in (True, False):
            c = [rows[k] for k in plain_chain([x[1] for x in rows], ahead)]
            names = {x[2] for x in c}
            s = [x for x in support.get(key, []) if x[0] in names and x[1] in names]
            on = [x[3] for x in c]
            contig = min(set(on), key=lambda v: (-on.count(v), v))
            share = sum(x[2] == ahead for x in s) / len(s) if s else 0.0
            this = (len(c), len({x[:2] for x in s}), round(share * 1_000_000), contig)
            if len(c) > 1 and (best is None or this > best[0]):
                best = this, (*key, ahead, contig, len(c), this[1], round(share, 9), c[-1][0], c[0][0], min(x[1] for x in c), max(x[1] for x in c))
        if best:
            want.add(best[1])

    def rows_of_matches(*_):
        raise AssertionError("matches became rows")

    monkeypatch.setattr(placement, "anchors", rows_of_matches)
    monkeypatch.setattr(placement, "MATCHES", 500)
    lengths = queries.select("q", F.lit(1000).cast("long").alias("length")).distinct()
    got = placement.score_candidates(queries, pairs, chosen, index.tags, index.pairs, lengths)
    columns = [c.split()[0] for c in placement.SCORED.split(", ")]
    assert {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect()} == want and len(want) > 50
