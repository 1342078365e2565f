"""Reports on hand-built rows: ties, unknown names, repeated annotations, empty tables."""

from pyspark.sql import functions as F

from cairnline.operators import reports

HITS = "query string, target string, fident double, alnlen long, qstart long, qend long, tstart long, tend long, evalue double, bits double"


def test_hit_report(spark):
    rows = [("s|c|x1", "B1|p", 0.5, 10, 1, 10, 1, 5, 1e-5, 50.0), ("s|c|x1", "B2|p", 0.5, 10, 1, 10, 1, 5, 1e-5, 50.0), ("s|c|x1", "B9|p", 0.9, 90, 1, 10, 1, 5, 1e-5, 49.0), ("odd", "B1", 1.0, 5, 1, 5, 1, 5, 0.0, 9.0)]
    df = lambda d, s: spark.createDataFrame(d, s)
    hits, q, t = df(rows, HITS), df([("s|c|x1", 20), ("s|c|x1", 10)], "query string, length long"), df([("B2|p", 10), ("B1", 0)], "target string, length long")
    fam = df([("B2", "kinase"), ("B2", "abc")], "accession string, family string")
    got = {r["query"]: (r["target"], r["family"], r["pident"], r["query_coverage"], r["target_coverage"]) for r in reports.hit_report(hits, q, t, fam).collect()}
    assert got == {"s|c|x1": ("B2|p", "kinase", 50.0, 50.0, 50.0), "odd": ("B1", "", 100.0, 0.0, 0.0)}
    features = df([("a|x1", "s", "c"), ("x1", "s", "c"), ("a|x2", "s", "c"), (None, None, None)], "gene_id string, genome_id string, contig_id string")
    joined = [(r["gene_id"], r["target"]) for r in reports.features_with_hits(features, reports.hit_report(hits, q, t, fam)).collect()]
    assert sorted(joined, key=str) == sorted([("a|x1", "B2|p"), ("x1", "B2|p"), ("a|x2", None), (None, None)], key=str)
    assert reports.hit_report(hits.limit(0), q, t, fam).count() == 0


def test_crosswalk(spark):
    hits = spark.createDataFrame([("gb|ARO:1|ARO:2", "T one", 0.5, 10, 5.0), ("gb|ARO:1|ARO:2", "U two", 0.5, 10, 5.0), ("none", "T one", 0.5, 10, 1.0)], "query string, target string, fident double, alnlen long, bits double")
    classes = spark.createDataFrame([("U", "g", "beta", "s"), ("U", "g", "alpha", "s")], "name string, gene_family string, class string, subtype string")
    terms = spark.createDataFrame([("ARO:1", "fam", "drug")], "term string, family string, drug_class string")
    both = {"whole": (hits, classes, F.col("target")), "word": (hits, classes, F.split_part("target", F.lit(" "), F.lit(1)))}
    rows = reports.crosswalk(both, terms)
    got = {(r["search"], r["query"]): (r["term"], r["family"], r["target"], r["class"], r["subtype"]) for r in rows.collect()}
    assert got == {
        ("whole", "gb|ARO:1|ARO:2"): ("ARO:1", "fam", "U two", "Unclassified", ""), ("word", "gb|ARO:1|ARO:2"): ("ARO:1", "fam", "U two", "beta", "s"),
        ("whole", "none"): ("", "", "T one", "Unclassified", ""), ("word", "none"): ("", "", "T one", "Unclassified", ""),
    }
    assert {(r["search"], r["class"], r["queries"]) for r in reports.crosswalk_counts(rows).collect()} == {("whole", "Unclassified", 2), ("word", "beta", 1), ("word", "Unclassified", 1)}


def test_series_metadata(spark):
    one = lambda name, rows, s: spark.createDataFrame(rows, s)
    meta = one("m", [("g1", "sp1"), ("g2", "sp2"), ("g3", "sp3")], "genome string, cluster string")
    tax = one("t", [("g1", "Bacteria")], "accession string, taxonomy string")
    got = reports.series_metadata(meta, tax, one("f", [("a/g1.fna",), ("b/g1.fna",), ("b/g3.fna",)], "path string"), one("l", [("x/g1.tgt",), ("x/g1.tgt",), ("x/g2.tgt",)], "path string")).orderBy("genome_id").collect()
    assert [tuple(r) for r in got] == [("g1", "sp1", "Bacteria", "b/g1.fna", 1), ("g2", "sp2", "sp2", "", 0)]
