"""Proportional stratified interleaving: every shard gets the mixture of the whole.

Rows are ranked by a seeded digest within their source; a row's fractional rank, (rank - u) / n, says
how far through its source it stands, where u from 0 to 1 is a digest of the source: sources of one row,
or of a few, fall anywhere and not all at the same place. Sorted by fractional rank the sources
interleave in proportion, and cutting that order into equal runs of rows gives shards that all match
the mixture (law ``rows``: row counts differ by one at most).

Neither ranking needs all rows of a source, or of the table, in one task. The digest covers id, text
checksum and size, so rows that share an id or have none are spread as well; its leading digits deal
each source into buckets, and bucket sizes, summed up, give the rank at which each bucket begins. The
global order is dealt into equal strips of fractional rank in the same manner.

Defined results: a null source counts as the empty name; a null text has no bytes and the checksum
of no bytes; rows with the same digest are ordered by id, checksum and size, and wholly equal rows
are interchangeable (a source's wholly equal rows share a bucket); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def interleave(docs: DataFrame, shards: int, seed: str = "interleave", buckets: int = 4096, strips: int = 4096) -> DataFrame:
    """Columns ``doc_id, source, size, text_crc32, shard, slot`` for all rows of ``docs``.

    ``buckets`` and ``strips`` bound what one task sorts: rows of the largest source over buckets,
    and all rows over strips. Raise them with the table; at most 65,536 and 100,000."""
    if shards < 1 or not 1 <= buckets <= 65_536 or not 1 <= strips <= 100_000:
        raise ValueError("shards, buckets or strips out of range")
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "text_crc32", "size").cast("binary")))
    keyed = keyed.withColumn("bucket", F.pmod(F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), F.lit(65_536)) * F.lit(buckets) / F.lit(65_536))
    keyed = keyed.withColumn("bucket", F.floor("bucket").cast("int"))
    in_source = Window.partitionBy("source")
    sizes = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "source",
        "bucket",
        (F.sum("n").over(in_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(in_source).alias("n_source"),
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("place", F.row_number().over(in_bucket)).join(sizes, ["source", "bucket"])
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).select(
        "doc_id", "source", "size", "text_crc32", "rank", ((F.col("rank") - u) / F.col("n_source")).alias("part")
    )
    ranked = materialise(ranked.withColumn("strip", F.floor(F.col("part") * strips).cast("int")), "interleave")
    # One row a strip, so these windows and this broadcast are bounded by ``strips``.
    begins = ranked.groupBy("strip").agg(F.count(F.lit(1)).alias("n")).select(
        "strip",
        (F.sum("n").over(Window.orderBy("strip").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    in_strip = Window.partitionBy("strip").orderBy("part", "source", "rank")
    placed = ranked.withColumn("place", F.row_number().over(in_strip)).join(F.broadcast(begins), "strip")
    placed = placed.withColumn("at", F.col("before") + F.col("place") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast((at * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))
