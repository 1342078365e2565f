"""Scalar functions, digestion, sketching and series statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnline.functions import scalar
from cairnline.operators import series
from cairnline.operators.catalog import ENZYMES, enzyme_list, landmark_mode
from cairnline.operators.digest import LANDMARKS, digest, digest_native, landmark_source, reject_mixed
from cairnline.operators.sketch import sketch, sketch_sequence, splitmix64, splitmix64_native


def dna(n, v=20240517):
    out = []
    for _ in range(n):
        v = (v * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("ACGT"[(v >> 33) % 4])
    return "".join(out)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    s = lambda x: F.lit(x)
    assert [value(spark, scalar.revcomp(s(x))) for x in ("ATCG", "AATT")] == ["CGAT", "AATT"]
    assert [value(spark, scalar.gc_content(s(x))) for x in ("GCGC", "ATAT", "ATCG", "")] == [1.0, 0.0, 0.5, 0.0]
    assert value(spark, scalar.canonical(s("GGGGTTTT"))) == "AAAACCCC"
    assert value(spark, scalar.hamming(s("ACGT"), s("AGGTA"))) == 2
    assert value(spark, scalar.clean_field(s(" a,b,, "))) == "a,b"
    assert [value(spark, scalar.strand(s(x))) for x in ("1", "-1", "-", "?")] == ["+", "-", "-", "+"]
    assert value(spark, scalar.feature_tokens({"ko": s("K1, k2"), "pfam": s("PF1|PF2")}, s("Hypothetical ABC transporter protein"))) == ["KO:K1", "KO:K2", "PFAM:PF1", "PFAM:PF2", "PRODUCT:abc_transporter"]
    assert [value(spark, scalar.token_weight(s(x))) for x in ("KO:1", "COG:1", "PRODUCT:x")] == [3.0, 2.0, 1.0]
    for length, want in ((600_000, (25, 15)), (120_000, (15, 8)), (60_000, (10, 5)), (20_000, (5, 2)), (1000, (0, 0))):
        assert tuple(value(spark, c) for c in scalar.support_thresholds(s(length))) == want
    assert scalar.parse_size("50kb") == 51_200 and scalar.parse_size("12") == 12
    assert [value(spark, scalar.circular_header(s(h))) for h in ("x [topology=circular]", "x circular", "x circular=false", "x linear")] == [True, True, False, False]
    assert value(spark, scalar.placement_score(*(s(1.0) for _ in range(6)))) == pytest.approx(1.0)


def test_catalog():
    assert len(ENZYMES) == 16 and [e.name for e in enzyme_list("bcgi, HaeIV")] == ["BcgI", "HaeIV"]
    assert landmark_mode("2bRAD") == "enzyme"
    with pytest.raises(ValueError):
        enzyme_list("nope")


@pytest.mark.parametrize("seq, strand", [("A" * 10 + "CGA" + "A" * 6 + "TGC" + "A" * 10, "+"), ("T" * 10 + "GCA" + "T" * 6 + "TCG" + "T" * 10, "-")])
def test_one_site(spark, seq, strand):
    c = spark.createDataFrame([("g", 1, seq), ("g", 2, ""), ("g", 3, "N" + seq[1:]), ("g", 4, None)], "genome string, contig_id long, seq string")
    found = digest(c, [ENZYMES["BcgI"]]).collect()
    assert [(r["contig_id"], r["pos"], r["strand"]) for r in found] == [(1, 0, strand)]


def test_native_digest_agrees(spark):
    c = spark.createDataFrame([("g", n, dna(3000, n)) for n in range(4)], "genome string, contig_id long, seq string")
    for name in ("BcgI", "HaeIV", "BaeI", "CspCI"):
        key = ("contig_id", "pos", "seq", "strand")
        assert sorted(map(tuple, digest(c, [ENZYMES[name]]).select(*key).collect())) == sorted(map(tuple, digest_native(c, ENZYMES[name]).select(*key).collect()))


def test_hash(spark):
    want = [16294208416658607535, 10451216379200822465, 2466975172287755897]
    assert splitmix64(np.array([0, 1, 123456789], np.uint64)).tolist() == want
    df = spark.createDataFrame([(0,), (1,), (123456789,)], "x long")
    assert [r["z"] % 2**64 for r in splitmix64_native(df, "x", "z").orderBy("x").collect()] == want


def test_sketch(spark):
    seq = dna(60_000)
    at, _ = sketch_sequence(seq, 31, 100)
    assert len(at) == 609 and at[:2].tolist() == [101, 220]
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    other, _ = sketch_sequence(back, 31, 100)
    assert sorted((60_000 - 31 - other).tolist()) == at.tolist()
    c = spark.createDataFrame([("g", 1, seq)], "genome string, contig_id long, seq string")
    marks = sketch(c, 31, 100)
    assert marks.count() == 609 and landmark_source(marks).first()["source"] == "sketch"
    with pytest.raises(ValueError):
        sketch(c, 33)
    with pytest.raises(ValueError):
        reject_mixed(marks.unionByName(digest(spark.createDataFrame([("g", 1, dna(9000))], c.schema), [ENZYMES["HaeIV"]])))


def marks(spark, rows):
    return spark.createDataFrame([(g, c, n, p, s, "BcgI", "+", p) for n, (g, c, p, s) in enumerate(rows)], LANDMARKS + ", gpos long")


def test_series(spark):
    m = marks(spark, [("g", 1, p, f"{'ACGT'[n]}AAA") for n, p in enumerate((100, 1500, 3000))])
    assert [r["gap"] for r in series.gaps(m).orderBy("ord").collect()] == [None, 1400, 1500]
    s = series.gap_stats(m).first()
    assert (s["tags"], s["mean_gap"], s["median_gap"], s["max_gap"]) == (3, 1450.0, 1450.0, 1500)
    c = spark.createDataFrame([("g", n, x) for n, x in enumerate((80, 70, 50, 40, 30, 20))], "genome string, contig_id long, length long")
    assert series.n50(c).first()["n50"] == 70
    assert [r["offset"] for r in series.contig_offsets(c).orderBy("contig_id").collect()] == [0, 80, 150, 200, 240, 270]
    bins = series.density_bins(m, spark.createDataFrame([("g", 3001)], "genome string, length long"), 3)
    assert [r["tags"] for r in bins.orderBy("bin").collect()] == [1, 1, 1]
    w = series.share_windows(spark.range(11).withColumn("k", F.lit(1)), ["k"], ["id"], 3).groupBy("window").count().orderBy("window")
    assert [r["count"] for r in w.collect()] == [3, 3, 5]
