"""The driver's tables as series, contigs, features and hits."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import revcomp
from ..operators.catalog import ENZYMES
from ..operators.digest import digest
from ..operators.series import contig_offsets, on_series

LETTERS = string.ascii_lowercase + string.ascii_uppercase
BASES = "".join("ACGT"[n % 26 % 4] for n in range(52))
DENSE, SPARSE = "HaeIV", "BcgI"
#: Its site is found on a turned sequence where it was on the plain one, as not every catalogued site is.
SYMMETRIC = "CjeI"
#: In place of a grouping column: three series built from all documents, with known differences.
BUILT = "built"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str, genome: str = "source") -> DataFrame:
    """Documents as contigs: letters become bases, the rest goes. ``genome``: the column that groups
    them into series."""
    seq = F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGT]+", "")
    if genome == BUILT:
        return _built(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig_id"), seq.alias("seq")))
    d = table(spark, sf_dir, "documents").select(F.col(genome).alias("genome"), F.col("doc_id").alias("contig_id"), seq.alias("seq"))
    return d.withColumn("length", F.length("seq").cast("long"))


def _built(plain: DataFrame) -> DataFrame:
    """Every sequence as it is, with its middle third turned round, and with every 61st base an A."""
    n = F.expr("length(seq) div 3")
    third = lambda k: F.substring("seq", n * k + 1, n)
    turned = F.concat(third(0), revcomp(third(1)), F.expr("substring(seq, 2 * (length(seq) div 3) + 1)"))
    kinds = {"a_plain": F.col("seq"), "b_turned": turned, "c_changed": F.regexp_replace("seq", "([ACGT]{60})[ACGT]", "$1A")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("genome"), v.alias("seq")) for k, v in kinds.items()))).alias("s")
    return plain.select("contig_id", each).select("s.genome", "contig_id", "s.seq").withColumn("length", F.length("seq").cast("long"))


def landmarks(spark: SparkSession, sf_dir: str, enzyme: str = DENSE, genome: str = "source") -> DataFrame:
    """Landmarks with their places on the contig (``pos``) and the series (``gpos``)."""
    c = contigs(spark, sf_dir, genome)
    return on_series(digest(c, [ENZYMES[enzyme]]), contig_offsets(c.select("genome", "contig_id", "length")))


def letters(spark: SparkSession, sf_dir: str, enzyme: str = DENSE, genome: str = "source") -> DataFrame:
    """Landmarks of contigs that belong to a series, without their places on it, which cost a join."""
    return digest(contigs(spark, sf_dir, genome), [ENZYMES[enzyme]]).filter("genome IS NOT NULL AND contig_id IS NOT NULL")


def lengths(spark: SparkSession, sf_dir: str, genome: str = "source") -> DataFrame:
    return contigs(spark, sf_dir, genome).groupBy("genome").agg(F.sum("length").alias("length"))


def items(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Order lines as items of clusters: the order is the cluster, the part's kind, brand and size are
    its annotations. ``only``: of orders with these ``l_orderkey``."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li if only is None else li.join(only, "l_orderkey", "left_semi")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size", "p_name")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = li.join(p, "l_partkey").withColumn("rn", rn.cast("long"))
    return rows.select(
        F.concat_ws("_", "l_orderkey", "rn").alias("gene_id"), F.concat(F.lit("s"), (F.col("l_orderkey") % 100).cast("string")).alias("genome_id"),
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("contig_id"), (F.col("rn") * 1000).alias("start"), (F.col("rn") * 1000 + 900).alias("end"), F.lit("+").alias("strand"),
        F.col("p_name").alias("product"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("ko"), F.col("p_brand").alias("pfam"), F.col("p_size").cast("string").alias("cog"),
        F.lit("").alias("eggnog"), F.lit("").alias("smash_tool"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("cluster_id"),
    )


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items without explicit clusters: a user is a series, seconds are coordinates."""
    e = table(spark, sf_dir, "events")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long")
    return e.select(
        F.col("event_id").cast("string").alias("gene_id"), F.col("user_id").cast("string").alias("genome_id"), F.lit("c1").alias("contig_id"), at.alias("start"), (at + 60).alias("end"), F.lit("+").alias("strand"),
        F.col("event_type").alias("product"), F.col("event_type").alias("ko"), F.lit("").alias("pfam"), F.lit("").alias("cog"), F.lit("").alias("eggnog"), F.lit("").alias("smash_tool"), F.lit(None).cast("string").alias("cluster_id"),
    )
