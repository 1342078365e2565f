"""Clusters, placement, graph and evaluation on small built inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnline.operators import clusters, evaluate, graph, placement
from cairnline.operators.digest import LANDMARKS

FEATURES = "gene_id string, genome_id string, contig_id string, start long, end long, strand string, product string, ko string, pfam string, cog string, eggnog string, smash_tool string, cluster_id string"


def features(spark, rows):
    """rows: gene, genome, start, end, ko, product, cluster id."""
    return spark.createDataFrame([(g, s, "c1", a, z, "+", p, ko, "", "", "", "", c) for g, s, a, z, ko, p, c in rows], FEATURES)


def items(spark, rows):
    return clusters.with_tokens(features(spark, rows)).withColumn("cluster", F.concat_ws(":", "genome_id", "cluster_id"))


def test_build(spark):
    f = features(spark, [("a", "g", 1, 100, "K1", "", "bgc"), ("b", "g", 900_000, 900_100, "K2", "", "bgc")])
    assert [(r["cluster"], r["n"]) for r in clusters.build_clusters(f, 5000, 2).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()] == [("g:bgc", 2)]
    f = features(spark, [("a", "g", 1, 100, "", "", None), ("b", "g", 2000, 2100, "", "", None), ("c", "g", 100_000, 100_100, "", "", None)])
    built = clusters.build_clusters(f, 5000, 2)
    assert {r["cluster"] for r in built.collect()} == {"g:c1:000000001-000002100"} and built.count() == 2
    with pytest.raises(ValueError):
        clusters.build_clusters(f, 0, 2)


def test_two_scores(spark):
    i = items(spark, [("a", "q", 1, 9, "A", "x", "1"), ("b", "q", 10, 19, "B", "", "1"), ("c", "t", 1, 9, "A", "x", "2"), ("d", "t", 10, 19, "C", "", "2"), ("e", "t", 20, 29, "C", "", "2")])
    pairs = spark.createDataFrame([("q:1", "t:2")], "q string, t string")
    t = clusters.token_counts(i)
    got = {}
    for twice in (True, False):
        r = clusters.token_scores(clusters.token_overlap(pairs, t, t), twice).first()
        got[twice] = tuple(round(r[c], 6) for c in ("functional", "weighted", "copies"))
    assert got == {True: (0.666667, 0.470588, 0.625), False: (0.5, 0.307692, 0.785714)}


def test_order(spark):
    rows = [(f"{s}{n}", s, 10 * n, 10 * n + 5, ko, "", "c") for s, order in (("a", "123"), ("b", "321"), ("d", "13"), ("e", "123")) for n, ko in enumerate(order)]
    i = items(spark, rows)
    pairs = spark.createDataFrame([("a:c", "b:c"), ("a:c", "d:c"), ("a:c", "e:c")], "q string, t string")
    got = {r["t"]: r for r in clusters.score_pairs(pairs, i, i).collect()}
    assert got["b:c"]["inverted"] and not got["e:c"]["inverted"]
    assert got["d:c"]["order_score"] == 1.0
    assert all(got["e:c"][c] > 0.999 for c in ("functional", "weighted", "adjacency", "order_score", "copies", "score"))
    hits = clusters.search(i.filter("genome_id = 'a'"), i).orderBy("rank").collect()
    assert [r["t"] for r in hits][0] == "a:c" and len(hits) == 4


def test_chain():
    q, r = np.array([10, 20, 30, 40]), np.array([100, 200, 150, 300])
    assert len(placement.chain(q, r, True)) == 3
    c = placement.chain(q, np.array([300, 200, 150, 100]), False)
    assert len(c) == 4 and c[0] == 0 and len(placement.chain(q[:0], r[:0], True)) == 0


TAGS = ["AACA", "ACCA", "AGCA", "CACA", "CCCA", "CGCA", "GGGA"]


def marks(spark, genome, seqs, contig=1):
    return spark.createDataFrame([(genome, contig, n, 100 + 900 * n, s, "BcgI", "+", 100 + 900 * n) for n, s in enumerate(seqs)], LANDMARKS + ", gpos long")


@pytest.mark.parametrize("seqs, orientation", [(TAGS[:5], "+"), (TAGS[:5][::-1], "-")])
def test_placement(spark, seqs, orientation):
    ref = marks(spark, "genome_a", TAGS[:6]).unionByName(marks(spark, "genome_b", TAGS[6:]))
    q = placement.query_landmarks(marks(spark, "query", seqs))
    lengths = spark.createDataFrame([("query:1", 10_000)], "q string, length long")
    ranked = placement.search(q, placement.build_index(ref), lengths, 3, 2)
    meta = spark.createDataFrame([("genome_a", "test_species")], "genome string, species_cluster string")
    r = placement.placements(ranked, q, meta).first()
    assert (r["best_genome"], r["best_species"], r["shared_tags"], r["shared_pairs"], r["orientation"]) == ("genome_a", "test_species", 5, 4, orientation)
    nothing = placement.placements(ranked, placement.query_landmarks(marks(spark, "other", ["TTTG"])), meta).first()
    assert (nothing["best_genome"], nothing["score"]) == ("*", 0.0)


def test_chimera_and_scaffold(spark):
    a, b = TAGS[:4], ["GTAC", "GTTC", "GAAC", "GATC"]
    ref = marks(spark, "ga", a).unionByName(marks(spark, "gb", b))
    mixed = marks(spark, "q", a + b)
    meta = spark.createDataFrame([("ga", "sa"), ("gb", "sb")], "genome string, species_cluster string")
    scan = placement.chimera_scan(mixed, placement.build_index(ref), meta, 3600, 2).orderBy("segment").collect()
    assert [r["best_species"] for r in scan] == ["sa", "sb"] and [r["transition"] for r in scan] == [False, True]
    sizes = spark.createDataFrame([(1, 5000)], "contig_id long, length long")
    s = placement.scaffold(ref, marks(spark, "draft", [x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in a]), sizes, 2)
    assert s.first()["reverse"] and placement.agp(s).count() == 1


def test_graph(spark):
    m = marks(spark, "a", TAGS[:5]).unionByName(marks(spark, "b", TAGS[:5]))
    e = graph.edges(m)
    assert e.count() == 4 and {r["weight"] for r in e.collect()} == {2}
    p = graph.linear_paths(e)
    assert p.first()["path"] in (TAGS[:5], TAGS[:5][::-1]) and p.count() == 1
    assert graph.path_scores(p, e, 2).first()["score"] == pytest.approx(0.5**0.5)
    b = graph.blocks(p, graph.nodes(m))
    assert b.count() == 2 and b.first()["tags"] == 5 and graph.indels(p, b, graph.nodes(m)).count() == 0
    assert graph.common_tags(m).count() == 5
    mixed = marks(spark, "a", [TAGS[n] for n in (0, 1, 2, 3, 4)]).unionByName(marks(spark, "b", [TAGS[n] for n in (0, 1, 4, 3, 2)]))
    weight = {(r["src"], r["tgt"]): r["weight"] for r in graph.edges(mixed).collect()}
    assert weight[TAGS[0], TAGS[1]] == 2 and weight[TAGS[1], TAGS[4]] == 1
    ring = graph.edges(marks(spark, "a", [*TAGS[:4], TAGS[0]]))
    assert len(graph.linear_paths(ring).first()["path"]) == 4
    near = marks(spark, "a", ["AAAAAAAA"]).unionByName(marks(spark, "b", ["AAAAAAAC"]))
    assert graph.tolerant_tags(near, 1).first()["members"] == 2 and graph.tolerant_tags(near, 0).count() == 0


def test_evaluate(spark):
    found = spark.createDataFrame([("x", 100), ("x", 205), ("x", 900)], "k string, pos long")
    truth = spark.createDataFrame([("x", 110), ("x", 200), ("y", 5)], "k string, pos long")
    got = {r["k"]: (r["matched"], r["false_pos"], r["missed"], r["error"]) for r in evaluate.greedy_matches(found, truth, "k", 50).collect()}
    assert got == {"x": (2, 1, 0, 15.0), "y": (0, 0, 1, 0.0)}
    inner = spark.createDataFrame([("c", 1, 50, 60), ("c", 2, 500, 600), ("c", 3, 9, 900)], "c string, id long, start long, end long")
    outer = spark.createDataFrame([("c", "r1", 0, 100), ("c", "r2", 40, 700)], "c string, region string, rs long, re long")
    assert {r["id"]: r["region"] for r in evaluate.containment_first(inner, outer, "c", 64).collect()} == {1: "r1", 2: "r2"}
