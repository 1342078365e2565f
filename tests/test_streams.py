"""Binary landmark files and archives, read as streams."""

import gzip
import io
import struct
import tarfile

import pytest

from cairnline.sources import files, streams


def entry(seq, at, source, strand, contig):
    return seq.encode().ljust(32, b"\0") + struct.pack("<QBBH4x", at, source, strand, contig)


def record(version=3, mark=b"TGT\x02", gap=500, name=b"G1"):
    out = mark + struct.pack("<IQIHH24x", version, 10_000, 2, 1, 2) + struct.pack("<H", len(name)) + name
    out += entry("ATCG", 100, 0, 1, 1) + entry("GCTA", 600, 16, 0, 0) + struct.pack("<I", gap)
    out += b"".join(struct.pack("<H", len(n)) + n for n in (b"c1", b"c2"))
    return out + (b"\0\1" if version == 3 else b"")


def test_binary_bytes(spark, tmp_path):
    (tmp_path / "a.tgt").write_bytes(record() + record(2, name=b"G2"))
    series, marks = streams.read_binary(spark, str(tmp_path / "a.tgt"))
    got = {r["genome"]: (r["length"], [(c["name"], c["circular"]) for c in r["contigs"]]) for r in series.collect()}
    assert got == {"G1": (10_000, [("c1", False), ("c2", True)]), "G2": (10_000, [("c1", False), ("c2", False)])}
    one = [tuple(r) for r in marks.filter("genome = 'G1'").orderBy("ord").collect()]
    assert one == [("G1", 1, 0, 100, "ATCG", "BcgI", "-", "c1"), ("G1", 0, 1, 600, "GCTA", "FracMinHash", "+", None)]


@pytest.mark.parametrize(("data", "why"), [
    (record(mark=b"TGT\x01"), "version 1"), (record(version=4), "version 2 or 3"), (record(gap=499), "stored gap"), (record()[:-3], "ends within"), (record() + b"TGT", "ends within"), (record().replace(struct.pack("<QBB", 600, 16, 0), struct.pack("<QBB", 600, 17, 0)), "unknown landmark source"),
])
def test_binary_refused(spark, tmp_path, data, why):
    (tmp_path / "a.tgt").write_bytes(data)
    with pytest.raises(Exception, match=why):
        streams.read_binary(spark, str(tmp_path / "a.tgt"))


def test_text_binary_text(spark, tmp_path, monkeypatch):
    text = [">G001|length=10000\n#contigs=c1:6000;c2:4000:circular\nBcgI:ATCG@100:c1/- -500- BcgI:GCTA@600:c2/+\n", ">G 2|length=7\n#contigs=x:7\nAlfI:AAAA@3:x/+ -0- AlfI:CCCC@1:x/- -2- AlfI:CCCC@3:x/-\n", ">G3|length=5\n#contigs=y:5\n"]
    (tmp_path / "a.tgt").write_text("".join(text))
    series, marks = files.read_tgt(spark, str(tmp_path / "a.tgt"))
    out = str(tmp_path / "bin")
    written = {r["genome"]: (r["file"], r["bytes"]) for r in streams.write_binary(marks, series, out).collect()}
    assert set(written) == {"G001", "G 2", "G3"} and all((tmp_path / "bin" / f.rsplit("/", 1)[1]).stat().st_size == n for f, n in written.values())
    series2, marks2 = streams.read_binary(spark, out)
    cols = ["genome", "contig_id", "ord", "gpos", "seq", "enzyme", "strand", "contig_name"]
    rows = lambda m: sorted(tuple(r) for r in m.select(*cols).collect())
    assert rows(marks2) == rows(marks)
    # contigs' lengths aren't in the binary file
    known = series.select("genome", "length", "contigs")
    assert sorted(r["value"] for r in files.tgt_text(marks2, known).collect()) == sorted(r["value"] for r in files.tgt_text(marks, known).collect())
    assert {(r["genome"], r["length"], tuple(c["name"] for c in r["contigs"])) for r in series2.collect()} == {(r["genome"], r["length"], tuple(c["name"] for c in r["contigs"])) for r in series.collect()}
    (tmp_path / "bin" / "text.tgt").write_text(">T|length=9\nBcgI:ATCG@1\n")
    both = streams.read_landmark_files(spark, out)
    assert {r["genome"] for r in both[0].collect()} == {"G001", "G 2", "G3", "T"} and both[1].count() == 6


def archive(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    fasta = b">c1 one\nACGT\nAC\n>c2\nGG-G\n"
    many = b"".join(b">r%d\n%s\n" % (n, b"ACGT" * 50_000) for n in range(60))
    archive(tmp_path / "part1.tar.gz", [("d/g1.fna.gz", gzip.compress(fasta)), ("d/readme.txt", b">x\nAAAA\n"), ("d/empty.fna", b"")])
    archive(tmp_path / "part2.tar", [("g1.fna", b">late\nTTTT\n"), ("g2.fna", fasta.replace(b"\n", b"\r\n")), ("big.fna", many)], "w")
    wanted = spark.createDataFrame([("g1",), ("g2",), ("big",), ("gone",), ("empty",)], "genome string")
    got = streams.read_archives(spark, str(tmp_path), wanted)
    rows = {(r["genome"], r["contig_id"]): (r["contig_name"], r["description"], r["seq"], r["offset"]) for r in got.filter("genome <> 'big'").collect()}
    assert rows == {(g, k): v for g in ("g1", "g2") for k, v in ((1, ("c1", "one", "ACGTAC", 0)), (2, ("c2", None, "GGG", 6)))}
    big = got.filter("genome = 'big'").agg({"length": "sum", "contig_id": "max"}).first()
    assert tuple(big) == (60 * 200_000, 60) or tuple(big) == (60, 60 * 200_000)
    report = {r["genome"]: r["archive"] and r["archive"].rsplit("/", 1)[1] for r in streams.archive_report(got, wanted).collect()}
    assert report == {"g1": "part1.tar.gz", "g2": "part2.tar", "big": "part2.tar", "gone": None, "empty": None}
    archive(tmp_path / "part3.tar", [("bad.fna", b"ACGT\n")], "w")
    with pytest.raises(Exception, match="before the first header"):
        streams.read_archives(spark, str(tmp_path))
