"""Work cut into blocks and rounds: list ranking, inversions, bounded cluster search."""

import random

import pytest

from cairnline.operators import clusters as C
from cairnline.operators import graph, structure


def walked(edges):
    """Chains of the undirected simple graph by walking."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for a in near:
        for b in near[a]:
            path = [a, b]
            if len(near[a]) == 2:
                continue
            while len(near[path[-1]]) == 2 and path[-1] != a:
                path.append((near[path[-1]] - {path[-2]}).pop())
            if path[0] < path[-1]:
                out.add(tuple(path))
            elif path[0] == path[-1]:
                out.add(ring(path[:-1]))
    on = {n for p in out for n in p}
    for a in near:
        if len(near[a]) == 2 and a not in on:
            path = [a, min(near[a])]
            while path[-1] != a:
                path.append((near[path[-1]] - {path[-2]}).pop())
            out.add(ring(path[:-1]))
    return out


def ring(nodes):
    at = nodes.index(min(nodes))
    nodes = nodes[at:] + nodes[:at]
    return tuple(nodes if nodes[1] < nodes[-1] else [nodes[0], *nodes[:0:-1]])


@pytest.mark.parametrize("seed", range(3))
def test_paths_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)]
    chain = [f"c{n:03}" for n in rng.sample(range(1000), 300)]
    edges += list(zip(chain, chain[1:], strict=False))
    edges += [(f"r{n}", f"r{(n + 1) % 7}") for n in range(7)] + [("j0", "j1"), ("j1", "j2"), ("j2", "j0"), ("j0", "tail"), ("j0", "tail2")]
    df = spark.createDataFrame(edges + edges[:5], "src string, tgt string")
    got = {tuple(r["path"]): r["path_id"] for r in graph.linear_paths(df).collect()}
    assert set(got) == walked(edges)
    assert all(i == f"{p[0]}>{p[1]}" for p, i in got.items())


def test_no_paths(spark):
    assert graph.linear_paths(spark.createDataFrame([("a", "a")], "src string, tgt string")).count() == 0


def test_kendall_tau_in_blocks(spark):
    """One pair of series holds everything; letters repeat, which ties their places in A."""
    rng = random.Random(3)
    seqs = [f"S{n:03}" for n in range(150)]
    rows = []
    for genome, order in (("a", seqs), ("b", rng.sample(seqs, 150) + rng.choices(seqs[:10], k=60)), ("c", seqs[::-1])):
        rows += [(genome, k // 40, seq, k * 30, k * 30, k, "E", "+") for k, seq in enumerate(order)]
    m = spark.createDataFrame(rows, "genome string, contig_id long, seq string, pos long, gpos long, ord long, enzyme string, strand string")
    last = {}
    for g, _, seq, _, at, *_ in rows:
        last[g, seq] = at
    want = {}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        pairs = [(last[a, seq], at) for g, _, seq, _, at, *_ in rows if g == b and (a, seq) in last]
        inv = sum(x[1] < y[1] and x[0] > y[0] for x in pairs for y in pairs)
        want[a, b] = (len(pairs), 1 - 2 * inv / (len(pairs) * (len(pairs) - 1) / 2))
    for block in (7, 1_000_000):
        got = {(r["ga"], r["gb"]): (r["common"], r["tau"]) for r in structure.kendall_tau(m, block).collect()}
        assert set(got) == set(want)
        for k in want:
            assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])


def test_near_pairs(spark):
    rng = random.Random(9)
    kinds = sorted({"".join(rng.choice("ACGT") for _ in range(rng.choice([1, 3, 6, 7]))) for _ in range(400)})
    df = spark.createDataFrame([(k,) for k in kinds], "seq string")
    for d in (1, 2):
        want = {(a, b) for a in kinds for b in kinds if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= d}
        assert {tuple(r) for r in graph.near_pairs(df, d).collect()} == want


def test_search_bounds_lose_nothing(spark):
    """Best targets equal a search that scores every seeded pair; blocks may be any size."""
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for g in range(rng.randrange(1, 7)):
            rows.append((f"g{c}_{g}", f"s{c % 5}", f"c{c}", g * 1000 + 1, g * 1000 + 900, "+", "", rng.choice(["K1", "K2", "K3", f"K{c}"]), rng.choice(["PF1", "PF2", "PF3"]), rng.choice([None, "C1", "C2"]), None, None, f"b{c}"))
    f = spark.createDataFrame(rows, "gene_id string, genome_id string, contig_id string, start long, end long, strand string, product string, ko string, pfam string, cog string, eggnog string, smash_tool string, cluster_id string")
    items = C.with_tokens(f).withColumn("cluster", C.F.col("cluster_id"))
    seeds = C.seeds(C.token_counts(items), C.token_counts(items), C.adjacencies(items), C.adjacencies(items))
    want = {}
    for r in C.score_pairs(seeds, items, items, True, 0.2).collect():
        want.setdefault(r["q"], []).append((-round(r["score"], 9), r["t"], r["missing"], r["extra"], r["inverted"]))
    for most in (1, 4):
        got = {}
        for r in C.search(items, items, 0.2, 0.0, most).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append((-round(r["score"], 9), r["t"], r["missing"], r["extra"], r["inverted"]))
        assert got == {q: sorted(v)[:most] for q, v in want.items()}
    p = C.postings(items)
    whole = {(r["q"], r["t"]) for r in C.meet(p, p, 0.2, 0.0, 4, 2.0).collect()}
    parts = {(r["q"], r["t"]) for r in C.meet(p, p, 0.2, 0.0, 4, 2.0, rows=150).collect()}
    assert whole == parts
