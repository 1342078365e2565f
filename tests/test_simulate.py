from cairnline.operators import simulate


def test_sequences(spark):
    c = spark.createDataFrame([("g", 1, "ACGTACGTAA" * 50)], "genome string, contig_id long, seq string")
    seq = c.first()["seq"]
    m = simulate.mutate(c, 0.1).first()["seq"]
    changed = sum(a != b for a, b in zip(seq, m, strict=True))
    assert len(m) == 500 and 20 < changed < 90 and simulate.mutate(c, 0.1).first()["seq"] == m
    assert simulate.mutate(c, 0.0).first()["seq"] == seq
    i = simulate.invert(c, 10, 30)
    assert simulate.invert(i, 10, 30).first()["seq"] == seq != i.first()["seq"]
    t = simulate.translocate(c, 0, 4, 100).first()["seq"]
    assert t == seq[4:104] + seq[:4] + seq[104:]
    p = simulate.cut(c, 120).orderBy("contig_id").collect()
    assert "".join(r["seq"] for r in p) == seq and len(p) == 5
    q = simulate.cut(c, 120, shuffle=True, turn=True).collect()
    assert sorted(r["contig_id"] for r in q) == [1, 2, 3, 4, 5] and sorted(len(r["seq"]) for r in q) == [20, 120, 120, 120, 120]


def test_clusters(spark):
    items = spark.createDataFrame([("c", f"g{n}", 10 * n, 10 * n + 9) for n in range(20)], "cluster string, gene_id string, start long, end long")
    assert 5 < simulate.perturb(items, loss=0.5).count() < 15
    assert simulate.perturb(items, keep=0.5).count() == 10
    turned = simulate.perturb(items, turned=True).orderBy("start").first()
    assert (turned["gene_id"], turned["cluster"], turned["truth"]) == ("g19", "p:c", "c")
