"""Built inputs with a known truth: mutated, rearranged, cut and perturbed series and clusters.

All choices are digests of ids and a seed, so inputs are the same on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import revcomp


def chance(*parts: Column | str, seed: str = "") -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(p) if isinstance(p, str) else p for p in parts)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mutate(contigs: DataFrame, rate: float, seed: str = "m") -> DataFrame:
    """Point substitutions at a share of the positions, each to another base."""
    def base(c: Column, n: Column) -> Column:
        turn = 1 + F.floor(chance("genome", "contig_id", n, F.lit(1), seed=seed) * 3)
        other = F.substring(F.lit("ACGTACGT"), (F.instr(F.lit("ACGT"), c) + turn).cast("int"), F.lit(1))
        return F.when((chance("genome", "contig_id", n, F.lit(0), seed=seed) < rate) & (F.instr(F.lit("ACGT"), c) > 0), other).otherwise(c)

    return contigs.withColumn("seq", F.array_join(F.transform(F.split("seq", ""), base), ""))


def invert(contigs: DataFrame, start: int, length: int) -> DataFrame:
    """The stretch from ``start`` (from 0) replaced by its reverse complement."""
    part = F.substring("seq", start + 1, length)
    return contigs.withColumn("seq", F.concat(F.substring("seq", 1, start), revcomp(part), F.expr(f"substring(seq, {start + length + 1})")))


def translocate(contigs: DataFrame, start: int, length: int, to: int) -> DataFrame:
    """The stretch cut out and put back at ``to`` of what is left."""
    part = F.substring("seq", start + 1, length)
    rest = F.concat(F.substring("seq", 1, start), F.expr(f"substring(seq, {start + length + 1})"))
    return contigs.withColumn("_r", rest).withColumn("seq", F.concat(F.substring("_r", 1, to), part, F.expr(f"substring(_r, {to + 1})"))).drop("_r")


def cut(contigs: DataFrame, size: int, shuffle: bool = False, turn: bool = False, seed: str = "c") -> DataFrame:
    """Contigs cut into pieces of a size, as contigs of their own: in order, or in an order fixed by the
    seed, and half of them reversed if asked."""
    pieces = contigs.withColumn("piece", F.explode(F.expr(f"sequence(0, cast(greatest(length(seq) - 1, 0) div {size} as int))")))
    pieces = pieces.withColumn("seq", F.expr(f"substring(seq, piece * {size} + 1, {size})"))
    if turn:
        pieces = pieces.withColumn("turned", chance("genome", "contig_id", "piece", seed=seed) < 0.5).withColumn("seq", F.when(F.col("turned"), revcomp(F.col("seq"))).otherwise(F.col("seq")))
    order = [F.xxhash64(F.lit(seed), "genome", "contig_id", "piece")] if shuffle else []
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("genome").orderBy(*order, "contig_id", "piece"))
    return pieces.withColumn("origin", F.struct("contig_id", "piece")).withColumn("contig_id", at.cast("long")).drop("piece")


def perturb(items: DataFrame, loss: float = 0.0, turned: bool = False, keep: float = 1.0, seed: str = "p") -> DataFrame:
    """Items of clusters with some lost, the order turned, or the end cut off: queries whose true target
    is the cluster they came from."""
    out = items.filter(chance("cluster", "gene_id", seed=seed) >= loss)
    if keep < 1.0:
        span = items.groupBy("cluster").agg(F.min("start").alias("_a"), F.max("end").alias("_z"))
        out = out.join(span, "cluster").filter(F.col("end") <= F.col("_a") + (F.col("_z") - F.col("_a")) * keep).drop("_a", "_z")
    if turned:
        out = out.withColumns({"start": -F.col("end"), "end": -F.col("start")})
    return out.withColumn("truth", F.col("cluster")).withColumn("cluster", F.concat(F.lit(f"{seed}:"), "cluster"))
