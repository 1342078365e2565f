"""Command line: each command reads files or tables and writes a table."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import workflows as W
from .functions.scalar import parse_size
from .operators import clusters, placement
from .session import session
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnline", description=__doc__)
    p.add_argument("--master", help="Spark master, where none is configured")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for o, default in options.items():
            c.add_argument("--" + o.replace("_", "-"), type=type(default) if default is not None else str, default=default)

    marks = {"mode": "enzyme", "enzymes": "BcgI", "k": 31, "scale": 750}
    command("digest", "fasta", "out", **marks)
    command("synteny", "landmarks", "out")
    command("compare", "fasta_a", "fasta_b", "out", **marks)
    command("scaffold", "reference", "draft", "out", min_tags=3)
    command("contig-index", "landmarks", "out")
    command("place-contig", "landmarks", "index", "out", metadata=None, min_tags=3, min_adjacencies=2, max_targets=10)
    command("scan-chimera", "landmarks", "index", "out", metadata=None, window="50kb", min_window_tags=3, min_confidence=0.0)
    command("cluster-ingest", "features", "out", genome="genome")
    command("cluster-build", "features", "out", max_gap=5000, min_genes=2)
    command("search-cluster", "query", "target", "out", max_gap=5000, min_genes=2, min_functional=0.0, min_synteny=0.0, max_targets=10)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session(a.master)
    how = {k: getattr(a, k) for k in ("mode", "enzymes", "k", "scale") if hasattr(a, k)}
    table = lambda path, name: spark.read.parquet(f"{path}/{name}")

    def metadata():
        if a.metadata:
            return files.read_metadata(spark, a.metadata)
        return table(a.index, "tags").select("genome").distinct().withColumn("species_cluster", F.lit(None).cast("string"))

    if a.command == "digest":
        contigs, marks = W.digest_fasta(spark, a.fasta, **how)
        contigs.drop("seq").write.mode("overwrite").parquet(f"{a.out}/contigs")
        marks.write.mode("overwrite").parquet(f"{a.out}/landmarks")
    elif a.command == "synteny":
        declared = table(a.landmarks, "contigs").filter("circular").select("genome", "contig_id")
        pairs, junctions = W.synteny(table(a.landmarks, "landmarks"), declared if declared.limit(1).count() else None)
        files.write_table(pairs, f"{a.out}/pairs", 5, "NA")
        files.write_table(junctions, f"{a.out}/junctions")
    elif a.command == "compare":
        files.write_table(W.compare_two(spark, a.fasta_a, a.fasta_b, **how), a.out, 5, "NA")
    elif a.command == "scaffold":
        sizes = table(a.draft, "contigs").select("contig_id", "length")
        files.write_table(placement.agp(placement.scaffold(table(a.reference, "landmarks"), table(a.draft, "landmarks"), sizes, a.min_tags)), a.out)
    elif a.command == "contig-index":
        tags, pairs = placement.build_index(table(a.landmarks, "landmarks"))
        files.write_index({"tags": tags, "pairs": pairs}, a.out)
    elif a.command == "place-contig":
        best, ranked = W.place(table(a.landmarks, "landmarks"), table(a.landmarks, "contigs"), files.read_index(spark, a.index), metadata(), a.min_tags, a.min_adjacencies, a.max_targets)
        files.write_table(best, f"{a.out}/placements")
        files.write_table(ranked, f"{a.out}/hits")
    elif a.command == "scan-chimera":
        ix = files.read_index(spark, a.index)
        files.write_table(placement.chimera_scan(table(a.landmarks, "landmarks"), (ix["tags"], ix["pairs"]), metadata(), parse_size(a.window), a.min_window_tags, a.min_confidence), a.out)
    elif a.command == "cluster-ingest":
        W.ingest(spark, a.features, a.genome).coalesce(1).write.mode("overwrite").csv(a.out, sep="\t", header=True, emptyValue="", nullValue="")
    elif a.command == "cluster-build":
        clusters.build_clusters(files.read_features(spark, a.features), a.max_gap, a.min_genes).write.mode("overwrite").parquet(a.out)
    elif a.command == "search-cluster":
        hits = W.search_features(files.read_features(spark, a.query), files.read_features(spark, a.target), a.max_gap, a.min_genes, min_functional=a.min_functional, min_adjacency=a.min_synteny, most=a.max_targets)
        files.write_table(hits, a.out)


if __name__ == "__main__":
    main()
