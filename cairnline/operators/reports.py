"""Reports joined from best hits, annotations and lists of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import best_hits

#: What a feature gets from its best hit.
FOUND = ["target", "accession", "family", "pident", "query_coverage", "target_coverage", "bits"]


def _one(df: DataFrame, key: str, value: str) -> DataFrame:
    """A value a key: of several the largest."""
    return df.groupBy(F.col(key).alias(f"_{key}")).agg(F.max(value).alias(value))


def hit_report(hits: DataFrame, query_lengths: DataFrame, target_lengths: DataFrame, families: DataFrame) -> DataFrame:
    """The best hit of each query, by bits, identity, aligned length and then the larger target, with identity and
    coverages in per cent and the family of the target's accession (its name before the first ``|``).

    ``hits`` as ``read_hits`` gives them; lengths as ``query, length`` and ``target, length``; ``families`` as
    ``accession, family``. Coverage is 0 where the length is unknown or 0, and a family not known is empty."""
    span = lambda a, b: F.col(b) - F.col(a) + 1
    h = hits.select("query", "target", "bits", (F.col("fident") * 100).alias("pident"), "alnlen", "evalue", span("qstart", "qend").alias("qspan"), span("tstart", "tend").alias("tspan"))
    best = best_hits(h, "query", ["bits", "pident", "alnlen", "target"]).withColumn("accession", F.split_part("target", F.lit("|"), F.lit(1)))
    q = _one(query_lengths, "query", "length").withColumnRenamed("length", "qlen")
    t = _one(target_lengths, "target", "length").withColumnRenamed("length", "tlen")
    met = best.join(q, best["query"] == q["_query"], "left").join(t, best["target"] == t["_target"], "left")
    f = _one(families, "accession", "family")
    met = met.join(f, met["accession"] == f["_accession"], "left")
    share = lambda s, n: F.coalesce(F.when(F.col(n) > 0, F.col(s) / F.col(n) * 100), F.lit(0.0))
    return met.select(
        "query", "target", "accession", F.coalesce("family", F.lit("")).alias("family"), "pident", "alnlen", "evalue", "bits", share("qspan", "qlen").alias("query_coverage"), share("tspan", "tlen").alias("target_coverage")
    )


def features_with_hits(features: DataFrame, report: DataFrame) -> DataFrame:
    """All features, with the hit of theirs where there is one, else nulls. A query is named
    ``series|contig|locus``; a feature's locus is what follows the last ``|`` of its id."""
    part = lambda n: F.split_part("query", F.lit("|"), F.lit(n))
    keyed = report.filter(F.size(F.split("query", r"\|")) >= 3).select(F.struct(part(1).alias("g"), part(2).alias("c"), part(-1).alias("l")).alias("_key"), *FOUND)
    best = best_hits(keyed, "_key", ["bits", "pident", "target"])
    key = F.struct(F.col("genome_id").alias("g"), F.col("contig_id").alias("c"), F.element_at(F.split("gene_id", r"\|"), -1).alias("l"))
    return features.withColumn("_key", key).join(best, "_key", "left").drop("_key")


def crosswalk(searches: dict[str, tuple[DataFrame, DataFrame, Column]], terms: DataFrame, prefix: str = "ARO:", unknown: str = "Unclassified") -> DataFrame:
    """Best hits of several searches with the terms named in the queries and the classes of the targets.

    ``searches``: name -> (hits ``query, target, fident, alnlen, bits``, classes ``name, gene_family, class, subtype``, the
    part of ``target`` that names the class). ``terms``: ``term, family, drug_class``. A query's term is the first
    of its ``|`` parts with the prefix. Of equal bits the larger target counts; a class not known is ``unknown``."""
    parts = []
    for name, (hits, classes, named) in searches.items():
        best = best_hits(hits.select("query", "target", "fident", "alnlen", "bits"), "query", ["bits", "target"])
        kind = classes.groupBy(F.col("name").alias("_name")).agg(F.max(F.struct("class", "gene_family", "subtype")).alias("k")).select("_name", "k.*")
        parts.append(best.withColumn("search", F.lit(name)).withColumn("_named", named).join(kind, F.col("_named") == F.col("_name"), "left").drop("_named", "_name"))
    rows = reduce(DataFrame.unionByName, parts)
    term = F.coalesce(F.try_element_at(F.filter(F.split("query", r"\|"), lambda p: p.startswith(prefix)), F.lit(1)), F.lit(""))
    known = terms.groupBy(F.col("term").alias("_term")).agg(F.max(F.struct("family", "drug_class")).alias("k")).select("_term", "k.*")
    met = rows.withColumn("term", term).join(known, F.col("term") == F.col("_term"), "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return met.select("search", "query", "term", blank("family"), blank("drug_class"), "target", blank("gene_family"), F.coalesce("class", F.lit(unknown)).alias("class"), blank("subtype"), "bits", "fident", "alnlen")


def crosswalk_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("search", "class").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("term").alias("terms"))


def series_metadata(metadata: DataFrame, taxonomy: DataFrame, fasta_files: DataFrame, landmark_files: DataFrame) -> DataFrame:
    """Metadata rows ``genome_id, species_cluster, taxonomy, fasta_path, is_representative`` of the series
    ``genome, cluster`` that have a landmark file; one with a sequence file is a representative. Files are rows
    ``path``, named ``<genome>.<ending>``; of several the largest path counts. Without a taxonomy
    (``accession, taxonomy``) the cluster stands for it."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    seq = fasta_files.groupBy(stem.alias("_s")).agg(F.max("path").alias("fasta_path"))
    marks = landmark_files.select(stem.alias("_m")).distinct()
    tax = taxonomy.groupBy(F.col("accession").alias("_a")).agg(F.max("taxonomy").alias("taxonomy"))
    g = F.col("genome")
    rows = metadata.select("genome", "cluster").join(marks, g == F.col("_m"), "left_semi").join(tax, g == F.col("_a"), "left").join(seq, g == F.col("_s"), "left")
    return rows.select(
        g.alias("genome_id"), F.col("cluster").alias("species_cluster"), F.coalesce("taxonomy", "cluster").alias("taxonomy"), F.coalesce("fasta_path", F.lit("")).alias("fasta_path"), F.col("fasta_path").isNotNull().cast("int").alias("is_representative")
    )
