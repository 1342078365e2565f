"""Files read by ranges of bytes."""

import gzip
import random

import pytest

from cairnline.sources import files


def made(records, lead=""):
    return lead + "".join(f">{name}\n{body}" for name, body in records)


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_records_across_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    records = [(f"c{n} about {n}", "".join("".join(rng.choices("ACGT", k=rng.randrange(70))) + rng.choice(["\n", "\r\n"]) for _ in range(rng.choice([0, 1, 3, 40])))) for n in range(120)]
    (tmp_path / "one.fa").write_bytes(made(records).encode())
    (tmp_path / "two.fna").write_bytes(made(records[:7], "\n\n").encode())
    with gzip.open(tmp_path / "three.fa.gz", "wb") as f:
        f.write(made(records[50:]).encode())
    (tmp_path / "none.fa").write_bytes(b"")
    assert spark.read.text(str(tmp_path / "one.fa"), lineSep="\n>").rdd.getNumPartitions() > 10
    got = {}
    for r in files.read_fasta(spark, str(tmp_path)).collect():
        got.setdefault(r["genome"], []).append((r["contig_id"], r["contig_name"], r["description"], r["seq"], r["offset"]))
    for name, part in (("one", records), ("two", records[:7]), ("three", records[50:])):
        at, want = 0, []
        for n, (head, body) in enumerate(part):
            seq = body.replace("\r", "").replace("\n", "")
            want.append((n + 1, head.split()[0], head.split(" ", 1)[1], seq, at))
            at += len(seq)
        assert sorted(got[name]) == want
    assert set(got) == {"one", "two", "three"}


def test_text_before_the_first_header(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nACGT\n")
    with pytest.raises(files.BadFile):
        files.read_fasta(spark, str(tmp_path / "bad.fa"))
