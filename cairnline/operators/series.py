"""Per-series windows and aggregates over landmark rows.

A series (``genome``) is the unit of order: windows run within a series or one of its contigs. Columns
as in ``digest.LANDMARKS``; ``contigs`` has ``genome, contig_id, length``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical, is_palindromic, is_reverse
from ..session import materialise
from . import ranges

RUN_GAP = 40  # landmarks of one run start less than so many bases apart


def contig_offsets(contigs: DataFrame, buckets: int = 256) -> DataFrame:
    """``contigs`` with ``offset``: total length of the series' contigs before each.

    Summed over ranges of contig ids first, so a series that holds most contigs is not one task."""
    low, high = contigs.agg(F.min("contig_id"), F.max("contig_id")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    c = contigs.withColumn("_b", F.floor((F.col("contig_id") - F.lit(low or 0)) / width))
    before = Window.partitionBy("genome").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = c.groupBy("genome", "_b").agg(F.sum("length").alias("_n")).select("genome", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("genome", "_b").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("_in", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(base, ["genome", "_b"])
    return out.withColumn("offset", F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def on_series(landmarks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Landmarks with ``gpos``, their place on the whole series."""
    return landmarks.join(offsets.select("genome", "contig_id", "offset"), ["genome", "contig_id"]).withColumn("gpos", F.col("pos") + F.col("offset")).drop("offset")


def oriented(landmarks: DataFrame) -> DataFrame:
    """Landmarks with ``canon``, ``rc`` (stored as the reverse of it) and ``pal`` (its own reverse), where they
    don't have them yet."""
    if {"canon", "rc", "pal"} <= set(landmarks.columns):
        return landmarks
    s = F.col("seq")
    return landmarks.withColumns({"canon": canonical(s), "rc": is_reverse(s), "pal": is_palindromic(s)})


def file_order() -> Window:
    return Window.partitionBy("genome").orderBy("contig_id", "ord")


def after_another(landmarks: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Landmarks with ``before_<column>``, of the landmark before in file order; nulls for a series' first.

    A window runs inside a contig. A contig's first landmark follows the last one of the nearest contig
    before that has any; only those, a row a contig, are put in the order of the whole series, in ranges."""
    marks = materialise(landmarks, "marks")
    held = F.struct(*columns)
    ends = materialise(marks.groupBy("genome", "contig_id").agg(F.max_by(held, "ord").alias("_end")), "ends")
    ends = ranges.before(ranges.ranged(ends, ["genome"], ["contig_id"], parts), ["genome"], ["contig_id"], {"_was": F.col("_end")})
    side = ends.filter("_was IS NOT NULL").select(F.col("genome").alias("_g"), F.col("contig_id").alias("_c"), "_was")
    near = marks.withColumn("_near", F.lag(held).over(Window.partitionBy("genome", "contig_id").orderBy("ord")))
    met = near.join(side, F.col("genome").eqNullSafe(F.col("_g")) & (F.col("contig_id") == F.col("_c")), "left")
    one = F.coalesce("_near", "_was")
    return met.withColumns({f"before_{c}": one[c] for c in columns}).drop("_g", "_c", "_near", "_was")


def gaps(landmarks: DataFrame, parts: int | None = None) -> DataFrame:
    """``gap`` to the landmark before in file order; 0 where the position does not grow, null for the
    first."""
    step = F.col("gpos") - F.col("before_gpos")
    return after_another(landmarks, ["gpos"], parts).withColumn("gap", F.when(step.isNotNull(), F.greatest(step, F.lit(0)))).drop("before_gpos")


def gap_stats(landmarks: DataFrame) -> DataFrame:
    """Landmarks, enzymes and mean, median and largest gap of each series."""
    return gaps(landmarks.select("genome", "contig_id", "ord", "gpos", "enzyme")).groupBy("genome").agg(
        F.count(F.lit(1)).alias("tags"), F.countDistinct("enzyme").alias("enzymes"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(0.0)).alias("median_gap"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"),
    )


def coverage(landmarks: DataFrame, lengths: DataFrame, tag_length: int = 32) -> DataFrame:
    """Share of each series (``genome, length``) that its landmarks would cover end to end."""
    n = landmarks.groupBy("genome").agg(F.count(F.lit(1)).alias("tags"))
    return lengths.join(n, "genome", "left").select(
        "genome", F.when(F.col("length") > 0, tag_length * F.coalesce("tags", F.lit(0)) / F.col("length")).otherwise(0.0).alias("coverage")
    )


def raw_pairs(landmarks: DataFrame) -> DataFrame:
    """Distinct unordered pairs ``genome, k1, k2`` of neighbours in file order."""
    pairs = after_another(landmarks.select("genome", "contig_id", "ord", "seq"), ["seq"]).filter(F.col("before_seq").isNotNull())
    return pairs.select("genome", F.least("seq", "before_seq").alias("k1"), F.greatest("seq", "before_seq").alias("k2")).distinct()


def n50(contigs: DataFrame) -> DataFrame:
    """Length such that contigs of at least it hold half of the series, and contig and base counts.
    Equal lengths are counted before they are put in order."""
    kinds = contigs.groupBy("genome", "length").agg(F.count(F.lit(1)).alias("many"))
    bases = F.col("length") * F.col("many")
    w = Window.partitionBy("genome").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = kinds.select("genome", "length", "many", bases.alias("bases"), F.sum(bases).over(w).alias("so_far"), F.sum(bases).over(Window.partitionBy("genome")).alias("total"))
    return sums.groupBy("genome").agg(
        F.max(F.when(F.col("so_far") * 2 >= F.col("total"), F.col("length"))).alias("n50"), F.sum("many").alias("contigs"), F.max("total").alias("length")
    )


def density_bins(landmarks: DataFrame, lengths: DataFrame, bins: int) -> DataFrame:
    """Landmarks in each of ``bins`` equal stretches of a series, empty ones too."""
    grid = lengths.select("genome", F.greatest(F.expr(f"(length + {bins - 1}) div {bins}"), F.lit(1)).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = landmarks.join(lengths.select("genome", "length"), "genome").select(
        "genome", F.least(F.expr(f"gpos div greatest((length + {bins - 1}) div {bins}, 1)"), F.lit(bins - 1)).cast("int").alias("bin")
    ).groupBy("genome", "bin").agg(F.count(F.lit(1)).alias("tags"))
    return grid.join(at, ["genome", "bin"], "left").select("genome", "bin", F.coalesce("tags", F.lit(0)).alias("tags"))


def islands(df: DataFrame, keys: list[str], order: list[str], joins: Column, name: str = "run") -> DataFrame:
    """Gaps and islands: ``name`` numbers maximal runs in which ``joins`` (an expression over ``lag``)
    holds between neighbours."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(joins, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def collapse_runs(landmarks: DataFrame, keys: list[str], gap: int = RUN_GAP) -> DataFrame:
    """Runs of landmarks less than ``gap`` apart on a contig, each by its smallest ``canon``."""
    w = Window.partitionBy(*keys, "contig_id").orderBy("pos", "canon")
    runs = islands(landmarks, [*keys, "contig_id"], ["pos", "canon"], F.col("pos") - F.lag("pos").over(w) < gap)
    best = F.min_by(F.struct("pos", "canon", "rc", "pal"), F.struct("canon", "pos")).alias("best")
    return runs.groupBy(*keys, "contig_id", "run").agg(best, F.count(F.lit(1)).alias("members")).select(*keys, "contig_id", "best.*", "members")


def index_stats(landmarks: DataFrame, contigs: DataFrame) -> DataFrame:
    """Landmarks, landmark kinds, contigs, bases and N50 of each series."""
    n = oriented(landmarks).groupBy("genome").agg(F.count(F.lit(1)).alias("tags"), F.countDistinct("canon").alias("identities"))
    return n50(contigs).join(n, "genome", "left").select(
        "genome", "contigs", "length", "n50", F.coalesce("tags", F.lit(0)).alias("tags"), F.coalesce("identities", F.lit(0)).alias("identities")
    )


def share_windows(df: DataFrame, keys: list[str], order: list[str], windows: int, name: str = "window") -> DataFrame:
    """Equal windows of n div w rows, the remainder in the last (unlike ``ntile``)."""
    w = Window.partitionBy(*keys)
    row = F.row_number().over(w.orderBy(*order)) - 1
    each = F.greatest(F.expr(f"_n div {windows}"), F.lit(1))
    out = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_row", row).withColumn("_each", each)
    return out.withColumn(name, F.least(F.expr("_row div _each"), F.lit(windows - 1)).cast("int")).drop("_n", "_row", "_each")


def multiplicity(landmarks: DataFrame) -> DataFrame:
    """Copies of each identity in each series."""
    return oriented(landmarks).groupBy("genome", "canon").agg(F.count(F.lit(1)).alias("copies"))
