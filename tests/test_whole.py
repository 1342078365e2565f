"""Queries that have to take the whole of their input, on small built tables."""

import hashlib

import numpy as np

from cairnline.operators import placement
from cairnline.operators.sketch import splitmix64
from cairnline.plans.registry import QUERIES
from test_clusters_placement import TAGS, marks

OTHER = str.maketrans("ACGT", "TGCA")


def test_scalars_on_whole_sequences(spark, tmp_path):
    head = "ACGT" * 10
    texts = {1: head + "AAAA", 2: head + "GGGG", 1_000_001: head + "GGGG", 2**40 + 1: head}
    spell = str.maketrans("ACGT", "abcd")  # the letters that become these bases
    rows = [(n, t.translate(spell), "s") for n, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["contig_id"]: r for r in QUERIES["scalar_functions_whole"](spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for n, s in texts.items():
        back = s[::-1].translate(OTHER)
        assert got[n]["rc"] == hashlib.sha256(back.encode()).hexdigest() and got[n]["pal"] == (back == s)
        assert got[n]["gc"] == round(sum(c in "GC" for c in s) / len(s), 6) and got[n]["h"] == int(hashlib.sha256(s.encode()).hexdigest()[:12], 16)
    want = {n: f"{int(splitmix64(np.array([n], np.uint64))[0]):X}" for n in texts}
    assert {r["x"]: r["h"] for r in QUERIES["splitmix_hash_whole"](spark, str(tmp_path)).collect()} == want


def test_scaffold_of_every_draft(spark):
    turned = [x[::-1].translate(OTHER) for x in TAGS[:4]]
    m = marks(spark, "a", TAGS[:4]).unionByName(marks(spark, "b", turned)).unionByName(marks(spark, "c", TAGS[:4]))
    sizes = spark.createDataFrame([(g, 1, n) for g, n in (("a", 500), ("b", 600), ("c", 700))], "genome string, contig_id long, length long")
    got = {r["genome"]: (r["begin"], r["end"], r["part"], r["shared"]) for r in placement.scaffold(m, m, sizes, 2, key="genome").collect()}
    assert {g: v[:3] for g, v in got.items()} == {"a": (1, 500, 1), "b": (1, 600, 1), "c": (1, 700, 1)}
    alone = {g: placement.scaffold(m.filter(f"genome <> '{g}'"), m.filter(f"genome = '{g}'"), sizes.drop("genome").filter(f"length = {n}"), 2).first() for g, n in (("a", 500), ("b", 600), ("c", 700))}
    assert {g: v[3] for g, v in got.items()} == {g: r["shared"] for g, r in alone.items()}


def test_search_counts_all_annotations(spark, tmp_path):
    lines = [(50, 1, 1, 1), (8, 1, 2, 1), (9, 1, 3, 1)]
    parts = [(1, "t", "BrandA", 5, "red pin"), (2, "t", "BrandA", 5, "blue nut"), (3, "t", "BrandB", 5, "green cap")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_size long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["t"]: r for r in QUERIES["cluster_search"](spark, str(tmp_path)).collect()}
    # brand and size in common: 2 of 4 and 4 tokens; size only: 1 of 4 and 4
    assert {t: r["functional"] for t, r in got.items()} == {"s50:o50": 1.0, "s8:o8": 0.5, "s9:o9": 0.25}
    assert (got["s8:o8"]["missing"], got["s8:o8"]["extra"], got["s9:o9"]["missing"]) == (2, 2, 3)
