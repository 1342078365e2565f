"""File formats round trip; incremental placement; the registry."""

import gzip

import pytest
from pyspark.sql import functions as F

from cairnline.operators import placement
from cairnline.operators.digest import LANDMARKS
from cairnline.sources import files
from cairnline.streaming.placement import place_stream


def test_fasta(spark, tmp_path):
    text = ">c1 one [topology=circular]\nACGTx\nacgtn\n>c2\nGG-GG\n"
    (tmp_path / "g1.fa").write_text(text)
    with gzip.open(tmp_path / "g2.fa.gz", "wt") as f:
        f.write(text)
    r = files.read_fasta(spark, str(tmp_path / "g*")).orderBy("genome", "contig_id").collect()
    assert [(x["genome"], x["contig_id"], x["contig_name"], x["seq"], x["offset"], x["circular"]) for x in r[:2]] == [("g1", 1, "c1", "ACGTACGTN", 0, True), ("g1", 2, "c2", "GGGG", 9, False)]
    assert r[2]["genome"] == "g2" and r[0]["description"] == "one [topology=circular]"
    (tmp_path / "bad.fa").write_text("ACGT\n")
    with pytest.raises(files.BadFile):
        files.read_fasta(spark, str(tmp_path / "bad.fa"))


def test_tgt(spark, tmp_path):
    (tmp_path / "a.tgt").write_text(">G001|length=10000\n#contigs=c1:6000;c2:4000:circular\nBcgI:ATCG@100:c1/- -500- BcgI:GCTA@600:c2\n")
    series, marks = files.read_tgt(spark, str(tmp_path / "a.tgt"))
    m = marks.orderBy("ord").collect()
    assert series.first()["length"] == 10_000 and [(x["contig_id"], x["gpos"], x["strand"]) for x in m] == [(1, 100, "-"), (2, 600, "+")]
    text = files.tgt_text(marks, series).first()["value"]
    assert text.splitlines()[2] == "BcgI:ATCG@100:c1/- -500- BcgI:GCTA@600:c2/+"
    (tmp_path / "b.tgt").write_text(">G\nBcgI:ATCG@100 -499- BcgI:GCTA@600\n")
    with pytest.raises(files.BadFile):
        files.read_tgt(spark, str(tmp_path / "b.tgt"))


def test_features_and_gff(spark, tmp_path):
    good = "\t".join(files.FEATURE_COLUMNS) + "\n" + "\t".join(["g1", "s", "c", "1", "90", "-1", "kinase", "K1,", "", "", "", "", "b1"]) + "\n"
    (tmp_path / "f.tsv").write_text(good)
    r = files.read_features(spark, str(tmp_path / "f.tsv")).first()
    assert (r["strand"], r["ko"], r["cluster_id"]) == ("-", "K1", "b1")
    for bad in (good.replace("\t90\t", "\t0\t"), good.replace("\tb1", ""), good.replace("gene_id", "gene")):
        (tmp_path / "x.tsv").write_text(bad)
        with pytest.raises(files.BadFile):
            files.read_features(spark, str(tmp_path / "x.tsv"))
    (tmp_path / "a.gff").write_text("#gff\nc1\tp\tCDS\t1\t90\t.\t-\t0\tID=x1;product=abc\nc1\tp\texon\t1\t90\t.\t-\t0\tID=x2\n")
    g = files.read_gff(spark, str(tmp_path / "a.gff"), "s").collect()
    assert [(x["gene_id"], x["product"], x["strand"]) for x in g] == [("x1", "abc", "-")]


def test_hits_metadata_index(spark, tmp_path):
    (tmp_path / "h.m8").write_text("q\tt\t90.5\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\nshort\tline\nq\tt\tx\t10\t0\t0\t1\t10\t1\t10\t1\t5\n")
    assert [x["bits"] for x in files.read_hits(spark, str(tmp_path / "h.m8")).collect()] == [50.0]
    (tmp_path / "m.tsv").write_text("genome_id\tcluster\ttax\tpath\trep\na\ts1\t\t\tyes\nb\t\t\t\t0\n")
    m = {x["genome"]: x for x in files.read_metadata(spark, str(tmp_path / "m.tsv")).collect()}
    assert m["a"]["is_representative"] and m["b"]["species_cluster"] is None
    (tmp_path / "d.tsv").write_text("a\ts\t\t\t1\na\ts\t\t\t1\n")
    with pytest.raises(files.BadFile):
        files.read_metadata(spark, str(tmp_path / "d.tsv"))
    files.write_index({"tags": spark.range(5)}, str(tmp_path / "ix"))
    assert files.read_index(spark, str(tmp_path / "ix"))["tags"].count() == 5
    with pytest.raises(files.BadFile):
        files.read_index(spark, str(tmp_path / "ix"), 2)
    files.write_table(spark.createDataFrame([("a", 0.5, None)], "n string, x double, m string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).filter(F.col("value").startswith("a")).first()["value"] == "a\t0.500000\t*"


def test_json_regions(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"records": [{"id": "c1", "features": [{"type": "region", "location": "[0:900](+)", "qualifiers": {"product": ["NRPS"]}}, {"type": "CDS", "location": "join{[10:50](+), [60:200](+)}", "qualifiers": {"locus_tag": ["x"]}}]}]}')
    r = {x["kind"]: x for x in files.read_regions_json(spark, str(tmp_path / "r.json")).collect()}
    assert (r["region"]["start"], r["region"]["end"], r["region"]["product"]) == (1, 900, "NRPS")
    assert (r["CDS"]["start"], r["CDS"]["end"], r["CDS"]["locus_tag"]) == (11, 200, "x")


def test_stream(spark, tmp_path):
    tags = ["AACA", "ACCA", "AGCA", "CACA", "CCCA"]
    schema = LANDMARKS + ", gpos long"
    rows = lambda g: [(g, 1, n, 100 + 900 * n, s, "BcgI", "+", 100 + 900 * n) for n, s in enumerate(tags)]
    index = placement.build_index(spark.createDataFrame(rows("ref"), schema))
    spark.createDataFrame(rows("q1"), schema).write.parquet(str(tmp_path / "in"))
    meta = spark.createDataFrame([("ref", "sp")], "genome string, species_cluster string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    place_stream(stream, index, meta, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r["q"], r["best_genome"], r["shared_tags"]) == ("q1:1", "ref", 5)


def test_registry():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 60 and set(o) <= set(q)


def test_gff_repeats_and_quotes(spark, tmp_path):
    (tmp_path / "q.gff").write_text('c1\tp\tCDS\t1\t90\t.\t-\t0\tID=x1;product="abc;ID=x9;Name=a=b\nc1\tp\tgene\t1\t9\t.\t+\t0\tName=n2\n')
    got = {r["gene_id"]: r["product"] for r in files.read_gff(spark, str(tmp_path / "q.gff"), "s").collect()}
    assert got == {"x1": '"abc', "n2": "n2"}
    (tmp_path / "m.tsv").write_text('g1\tsp1\t"open\tp1\t1\ng2\tsp2\tx"\tp2\t0\n')
    assert {r["genome"]: r["taxonomy"] for r in files.read_metadata(spark, str(tmp_path / "m.tsv")).collect()} == {"g1": '"open', "g2": 'x"'}
