"""Whole workflows over files: what the command line runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clusters, placement, structure
from .operators.catalog import enzyme_list, landmark_mode
from .operators.digest import digest, reject_mixed
from .operators.series import on_series
from .operators.sketch import sketch
from .session import materialise
from .sources import files


def digest_fasta(spark: SparkSession, path: str, mode: str = "enzyme", enzymes: str = "BcgI", k: int = 31, scale: int = 750) -> tuple[DataFrame, DataFrame]:
    """Contigs and landmarks (with ``gpos``) of FASTA files."""
    contigs = materialise(files.read_fasta(spark, path), "contigs")
    marks = digest(contigs, enzyme_list(enzymes)) if landmark_mode(mode) == "enzyme" else sketch(contigs, k, scale)
    return contigs, on_series(marks, contigs)


def series_table(contigs: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("contig_id", "contig_name", "length", "circular")))
    return contigs.groupBy("genome").agg(F.sum("length").alias("length"), F.transform(parts, lambda c: F.struct(c["contig_name"].alias("name"), c["length"].alias("length"), c["circular"].alias("circular"))).alias("contigs"))


def synteny(landmarks: DataFrame, circular: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of series, with nulls where fewer than two landmarks are shared, and the junctions.

    Series of mixed landmark sources are an error. The number of rows is that of pairs, by definition
    of the report; pairs without shared landmarks are only added at the end."""
    reject_mixed(landmarks)
    sources = [r[0] for r in landmarks.select(F.col("enzyme") == "FracMinHash").distinct().limit(3).collect()]
    if len(sources) > 1:
        raise ValueError("series of different landmark sources cannot be compared")
    marks = materialise(landmarks, "marks")
    table, junctions = structure.structural_pairs(marks, sketched=sources == [True], circular=circular)
    names = marks.select("genome").distinct()
    every = names.withColumnRenamed("genome", "ga").join(names.withColumnRenamed("genome", "gb"), F.col("ga") < F.col("gb"))
    return every.join(table, ["ga", "gb"], "left").join(structure.synteny_matrix(marks).select("ga", "gb", "synteny"), ["ga", "gb"], "left"), junctions


def compare_two(spark: SparkSession, a: str, b: str, **how) -> DataFrame:
    """Structural comparison of two FASTA files."""
    sides = [digest_fasta(spark, p, **how)[1] for p in (a, b)]
    return synteny(sides[0].unionByName(sides[1]))[0]


def place(queries: DataFrame, contigs: DataFrame, index: dict[str, DataFrame], metadata: DataFrame, min_tags: int = 3, min_pairs: int = 2, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Placements of each contig and all ranked candidates."""
    q = placement.query_landmarks(queries)
    lengths = contigs.select(F.concat_ws(":", "genome", "contig_id").alias("q"), "length")
    ranked = materialise(placement.search(q, (index["tags"], index["pairs"]), lengths, min_tags, min_pairs, most), "ranked")
    return placement.placements(ranked, q, metadata), ranked


def ingest(spark: SparkSession, path: str, genome: str) -> DataFrame:
    """A GFF file or feature table as features of a series, in order of place."""
    rows = files.read_gff(spark, path, genome) if path.rsplit(".", 1)[-1].lower() in ("gff", "gff3", "gtf") else files.normalise_features(files.read_features(spark, path), genome)
    return rows.orderBy("genome_id", "contig_id", "start", "gene_id")


def search_features(query: DataFrame, target: DataFrame, max_gap: int = 5000, min_genes: int = 2, **how) -> DataFrame:
    build = lambda f: materialise(clusters.with_tokens(clusters.build_clusters(f, max_gap, min_genes)), "items")
    return clusters.search(build(query), build(target), **how)
