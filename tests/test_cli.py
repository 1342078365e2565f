"""The command line end to end, on small files."""

from cairnline.__main__ import main
from cairnline.sources.files import FEATURE_COLUMNS


def dna(n, v):
    out = []
    for _ in range(n):
        v = (v * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("ACGT"[(v >> 33) % 4])
    return "".join(out)


def lines(spark, path):
    rows = [r["value"].split("\t") for r in spark.read.text(str(path)).collect()]
    head = rows[0]
    return [dict(zip(head, r, strict=True)) for r in rows if r != head]


def test_landmark_commands(spark, tmp_path):
    seq = dna(40_000, 5)
    turned = seq[:15_000] + seq[15_000:25_000][::-1].translate(str.maketrans("ACGT", "TGCA")) + seq[25_000:]
    for name, s in (("a", seq), ("b", turned), ("c", dna(40_000, 6))):
        (tmp_path / f"{name}.fa").write_text(f">{name}1\n{s}\n")
    p = str(tmp_path)
    main(["digest", f"{p}/*.fa", f"{p}/d", "--mode", "sketch", "--scale", "100"])
    main(["synteny", f"{p}/d", f"{p}/s"])
    pairs = {(r["ga"], r["gb"]): r for r in lines(spark, f"{p}/s/pairs")}
    assert pairs["a", "b"]["breakpoints"] == "2" and pairs["a", "c"]["score"] == "NA" and len(pairs) == 3
    main(["contig-index", f"{p}/d", f"{p}/ix"])
    main(["place-contig", f"{p}/d", f"{p}/ix", f"{p}/pl"])
    best = {r["q"]: r["best_genome"] for r in lines(spark, f"{p}/pl/placements")}
    assert best == {"a:1": "a", "b:1": "b", "c:1": "c"}
    main(["scan-chimera", f"{p}/d", f"{p}/ix", f"{p}/ch", "--window", "10kb"])
    assert len(lines(spark, f"{p}/ch")) == 12
    main(["digest", f"{p}/b.fa", f"{p}/one", "--mode", "sketch", "--scale", "100"])
    main(["scaffold", f"{p}/d", f"{p}/one", f"{p}/agp"])
    assert {r["component_type"] for r in lines(spark, f"{p}/agp")} == {"W"}


def test_cluster_commands(spark, tmp_path):
    rows = [[f"g{n}", "s", "c1", str(1 + 100 * n), str(90 + 100 * n), "+", "", f"K{n}", "", "", "", "", "bgc"] for n in range(3)]
    (tmp_path / "f.tsv").write_text("\n".join("\t".join(r) for r in [FEATURE_COLUMNS, *rows]) + "\n")
    p = str(tmp_path)
    main(["cluster-build", f"{p}/f.tsv", f"{p}/b"])
    assert spark.read.parquet(f"{p}/b").select("cluster").distinct().first()[0] == "s:bgc"
    main(["search-cluster", f"{p}/f.tsv", f"{p}/f.tsv", f"{p}/h"])
    hit = lines(spark, f"{p}/h")[0]
    assert hit["t"] == "s:bgc" and hit["score"] == "1.000000"
    main(["cluster-ingest", f"{p}/f.tsv", f"{p}/i", "--genome", "new"])
    assert lines(spark, f"{p}/i")[0]["genome_id"] == "new"
