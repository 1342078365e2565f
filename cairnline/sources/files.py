"""File formats: sequences, landmark text, features, hits, metadata, indexes and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import base_filter, circular_header, clean_field, location_bounds, strand
from ..operators.series import contig_offsets
from ..session import materialise

# The feature table's header.
FEATURE_COLUMNS = "gene_id genome_id contig_id start end strand product ko pfam cog eggnog smash_tool cluster_id".split()
HIT_COLUMNS = "query target fident alnlen mismatch gapopen qstart qend tstart tend evalue bits".split()


class BadFile(ValueError):
    pass


def _fail(bad: DataFrame, what: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise BadFile(f"{what}: {row[0].asDict()}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, value``: records of files whose records begin with ``>`` at a line's start, numbered from 0 in
    file order, without that sign; text before the first one has n -1.

    Records are the text source's lines with another separator, so a large file is read in many tasks, each
    finding the first record that begins in its range of bytes; a gzip file is one task. Numbers follow from
    the records of each range, never from one task over the file."""
    rows = spark.read.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    rows = materialise(rows, "records")
    ranges = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"), F.min_by(F.col("value").startswith(">"), "at").alias("opens"))
    ahead = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("many").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opens = F.first("opens").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select("file", "block", (before - F.col("first") - F.when(opens, 0).otherwise(1)).alias("shift"), opens.alias("opens"))
    n = F.col("at") + F.col("shift")
    value = F.when((n == 0) & F.col("opens"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    return rows.join(ranges, ["file", "block"]).select("file", n.alias("n"), value.alias("value"))


def read_fasta(spark: SparkSession, path: str, genome: str | None = None, check: bool = True) -> DataFrame:
    """Sequences ``genome, contig_id, contig_name, description, length, circular, seq, offset`` of FASTA
    files (gzip by extension). A file is one series, named by ``genome`` or its file name; contig ids
    count from 1 in file order. Letters other than ACGTN are dropped, which shifts later coordinates."""
    records = read_records(spark, path)
    if check:
        _fail(records.filter((F.col("n") < 0) & (F.length(F.trim(F.regexp_replace("value", r"[\r\n]", ""))) > 0)).select("file"), "text before the first header")
    name = F.lit(genome) if genome else F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.(fa|fasta|fna)(\.gz)?$", "")
    head = F.rtrim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace("value", r"^[^\r\n]*", "")
    rows = records.filter("n >= 0").select(
        name.alias("genome"), (F.col("n") + 1).alias("contig_id"), F.split_part(head, F.lit(" "), F.lit(1)).alias("contig_name"),
        F.nullif(F.regexp_extract(head, r"^[^ ]* (.*)$", 1), F.lit("")).alias("description"), circular_header(head).alias("circular"), base_filter(body).alias("seq"),
    )
    return contig_offsets(rows.withColumn("length", F.length("seq").cast("long")))


def read_tgt(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Landmark text files: series ``genome, length, contigs`` and landmarks. Places are explicit; stored
    gaps must agree with them. A missing strand means ``+``."""
    blocks = read_records(spark, path).select(F.col("value").alias("block")).filter(F.length(F.trim("block")) > 0)
    head = F.regexp_extract("block", r"^([^\r\n]*)", 1)
    names = F.regexp_extract("block", r"(?m)^#contigs=([^\r\n]*)", 1)
    line = F.regexp_extract("block", r"(?m)^([A-Za-z0-9]+:[A-Za-z]+@[^\r\n]*)", 1)
    series = blocks.select(
        F.split_part(head, F.lit("|"), F.lit(1)).alias("genome"),
        F.coalesce(F.regexp_extract(head, r"length=(\d+)", 1).try_cast("long"), F.lit(0)).alias("length"),
        F.transform(F.filter(F.split(names, ";"), lambda c: F.length(F.trim(c)) > 0), lambda c: F.struct(
            F.split_part(F.trim(c), F.lit(":"), F.lit(1)).alias("name"), F.split_part(F.trim(c), F.lit(":"), F.lit(2)).try_cast("long").alias("length"), F.trim(c).endswith(":circular").alias("circular"))).alias("contigs"),
        line.alias("line"),
    )
    parts = series.filter(F.length("line") > 0).select("genome", "contigs", F.posexplode(F.split("line", r"\s+")).alias("n", "item"))
    item = r"^([A-Za-z0-9]+):([A-Za-z]+)@(\d+)(?::([^/]*))?(?:/([+-]))?$"
    tags = parts.filter(F.col("item").contains("@")).select(
        "genome", "contigs", "n", F.regexp_extract("item", item, 2).alias("seq"), F.regexp_extract("item", item, 3).try_cast("long").alias("gpos"),
        F.regexp_extract("item", item, 1).alias("enzyme"), F.regexp_extract("item", item, 4).alias("contig_name"), strand(F.regexp_extract("item", item, 5)).alias("strand"),
    )
    if check:
        _fail(tags.filter(F.col("gpos").isNull()), "landmark without a place")
        gap = parts.filter(F.col("item").rlike(r"^-\d+-$")).select("genome", (F.col("n") + 1).alias("n"), F.regexp_extract("item", r"^-(\d+)-$", 1).cast("long").alias("stored"))
        w = Window.partitionBy("genome").orderBy("n")
        real = tags.select("genome", "n", F.greatest(F.col("gpos") - F.lag("gpos").over(w), F.lit(0)).alias("gap"))
        _fail(gap.join(real, ["genome", "n"]).filter("stored <> gap"), "stored gap differs from the places")
    at = F.coalesce(F.nullif(F.array_position(F.transform("contigs", lambda c: c["name"]), F.col("contig_name")), F.lit(0)), F.when(F.col("contig_name") == "", 0).otherwise(F.size("contigs") + 1))
    ordered = F.row_number().over(Window.partitionBy("genome").orderBy("n")) - 1
    return series.drop("line"), tags.select("genome", at.cast("long").alias("contig_id"), ordered.cast("long").alias("ord"), "gpos", "seq", "enzyme", "strand", F.nullif("contig_name", F.lit("")).alias("contig_name"))


def tgt_text(landmarks: DataFrame, series: DataFrame) -> DataFrame:
    """One text row a series, as ``read_tgt`` reads it: ``genome, value``. ``series``: genome, length,
    contigs (name, length, circular)."""
    w = Window.partitionBy("genome").orderBy("ord")
    step = F.col("gpos") - F.lag("gpos").over(w)
    gap = F.when(step.isNotNull(), F.greatest(step, F.lit(0)))
    contig = F.when(F.col("contig_name").isNotNull(), F.concat(F.lit(":"), "contig_name")).otherwise("")
    item = F.concat("enzyme", F.lit(":"), "seq", F.lit("@"), F.col("gpos").cast("string"), contig, F.lit("/"), "strand")
    item = F.when(gap.isNull(), item).otherwise(F.concat(F.lit("-"), gap.cast("string"), F.lit("- "), item))
    line = landmarks.withColumn("item", item).groupBy("genome").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda s: s["item"]), " ").alias("line"))
    names = F.array_join(F.transform("contigs", lambda c: F.concat(c["name"], F.lit(":"), c["length"].cast("string"), F.when(c["circular"], ":circular").otherwise(""))), ";")
    head = F.concat(F.lit(">"), "genome", F.lit("|length="), F.col("length").cast("string"))
    return series.join(line, "genome", "left").select("genome", F.concat_ws("\n", head, F.when(F.size("contigs") > 0, F.concat(F.lit("#contigs="), names)), "line").alias("value"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Series metadata: five positional columns, an optional header; a repeated id is an error."""
    raw = spark.read.csv(path, sep="\t", quote="", schema="genome string, species_cluster string, taxonomy string, fasta_path string, rep string")
    rows = raw.filter((F.lower("genome") != "genome_id") & (F.length(F.trim("genome")) > 0))
    _fail(rows.groupBy("genome").count().filter("count > 1"), "repeated series id")
    return rows.select("genome", *(F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("species_cluster", "taxonomy", "fasta_path")), F.lower(F.trim(F.coalesce("rep", F.lit("")))).isin("1", "true", "yes").alias("is_representative"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The 13-column feature table, strictly: header, number of columns and coordinates are checked."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    header = "\t".join(FEATURE_COLUMNS)
    cells = lines.filter(F.col("value") != header).select("value", F.split("value", "\t").alias("c"))
    if not lines.filter(F.col("value") == header).limit(1).count():
        raise BadFile("feature table without its header")
    _fail(cells.filter(F.size("c") != len(FEATURE_COLUMNS)).select("value"), "wrong number of columns")
    rows = cells.select(*(F.col("c")[n].alias(c) for n, c in enumerate(FEATURE_COLUMNS)))
    rows = rows.withColumns({c: F.col(c).try_cast("long") for c in ("start", "end")})
    _fail(rows.filter("start is null or end is null or end < start").select("gene_id"), "bad coordinates")
    return normalise_features(rows)


def normalise_features(rows: DataFrame, genome: str | None = None) -> DataFrame:
    """Clean optional fields and strands, set the series id, in order of place."""
    fields = {c: F.coalesce(clean_field(F.col(c)), F.lit("")) for c in ("product", "ko", "pfam", "cog", "eggnog", "smash_tool")}
    out = rows.withColumns({**fields, "strand": strand(F.coalesce("strand", F.lit("+"))), "cluster_id": clean_field(F.col("cluster_id"))})
    return (out.withColumn("genome_id", F.lit(genome)) if genome else out).select(*FEATURE_COLUMNS)


def read_gff(spark: SparkSession, path: str, genome: str) -> DataFrame:
    """Genes and coding sequences of a GFF3 file as features; items are named by ``gene_id``, ``ID``,
    ``Name`` or their line. Of a repeated attribute the first counts; quotes are letters."""
    raw = spark.read.csv(path, sep="\t", quote="", comment="#", schema="seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string")
    attr = F.transform(F.split(F.coalesce("attributes", F.lit("")), ";"), lambda a: F.struct(F.trim(F.substring_index(a, "=", 1)).alias("k"), F.regexp_extract(a, "=(.*)$", 1).alias("v")))
    rows = raw.filter(F.col("type").isin("gene", "CDS")).withColumn("m", attr)
    get = lambda *keys: F.coalesce(*(F.nullif(F.trim(F.try_element_at(F.filter("m", lambda a: a["k"] == k), F.lit(1))["v"]), F.lit("")) for k in keys))
    fallback = F.concat(F.lit(genome + "_"), F.xxhash64("seqid", "start", "end", "type").cast("string"))
    rows = rows.select(
        F.coalesce(get("gene_id", "ID", "Name"), fallback).alias("gene_id"), F.lit(genome).alias("genome_id"), F.col("seqid").alias("contig_id"), "start", "end", "strand",
        get("product", "Name").alias("product"), get("ko", "KO").alias("ko"), get("pfam", "PFAM").alias("pfam"), get("cog", "COG").alias("cog"), get("eggnog", "eggNOG").alias("eggnog"), F.lit("").alias("smash_tool"), F.lit(None).cast("string").alias("cluster_id"),
    )
    _fail(rows.filter("end < start").select("gene_id", "start", "end"), "bad coordinates")
    return normalise_features(rows)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Alignment hits in twelve columns; short or unreadable lines are skipped."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 12)
    kinds = {"query": "string", "target": "string", "fident": "double", "evalue": "double", "bits": "double"}
    rows = cells.select(*(F.col("c")[n].try_cast(kinds.get(c, "long")).alias(c) for n, c in enumerate(HIT_COLUMNS)))
    return rows.filter(" and ".join(f"{c} is not null" for c in ("query", "target", "fident", "alnlen", "evalue", "bits")))


def join_annotations(genes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Features of predicted genes (contig_id, start, end, ...) with annotations of the same place."""
    return genes.join(annotations, ["contig_id", "start", "end"])


def read_regions_json(spark: SparkSession, path: str) -> DataFrame:
    """Regions and coding sequences of a region-caller's JSON: ``record, kind, start, end, product,
    locus_tag``."""
    qualifiers = "struct<product:array<string>,locus_tag:array<string>>"
    schema = T.StructType.fromDDL(f"records array<struct<id:string,features:array<struct<type:string,location:string,qualifiers:{qualifiers}>>>>")
    f = spark.read.json(path, multiLine=True, schema=schema).select(F.explode("records").alias("r")).select(F.col("r.id").alias("record"), F.explode("r.features").alias("f"))
    low, high = location_bounds(F.col("f.location"))
    first = lambda c: F.try_element_at(F.col(f"f.qualifiers.{c}"), F.lit(1))
    return f.filter(F.col("f.type").isin("region", "CDS")).select("record", F.col("f.type").alias("kind"), (low + 1).alias("start"), high.alias("end"), first("product").alias("product"), first("locus_tag").alias("locus_tag"))


def external_set(rows: DataFrame, source: str, group: str, name: str, token: str) -> DataFrame:
    """Features of an outside collection without coordinates: items get places in the order of names."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(name))
    empty = F.lit("")
    return rows.select(
        F.col(name).alias("gene_id"), F.lit(source).alias("genome_id"), F.col(group).alias("contig_id"), (place * 1000).cast("long").alias("start"), (place * 1000 + 900).cast("long").alias("end"), F.lit("+").alias("strand"),
        F.col(name).alias("product"), empty.alias("ko"), F.col(token).alias("pfam"), empty.alias("cog"), empty.alias("eggnog"), empty.alias("smash_tool"), F.col(group).alias("cluster_id"),
    )


def write_index(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """An index is a folder of Parquet tables with a row of metadata; postings are clustered by key so
    that row-group statistics prune look-ups."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.repartitionByRange(df.columns[0]).sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(version, ",".join(sorted(tables)))], "version int, tables string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_index_meta".replace("/_index", "/index"))


def read_index(spark: SparkSession, path: str, version: int = 1) -> dict[str, DataFrame]:
    meta = spark.read.parquet(f"{path}/index_meta").first()
    if meta["version"] != version:
        raise BadFile(f"index version {meta['version']}, expected {version}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"].split(",")}


def write_table(df: DataFrame, path: str, places: int = 6, missing: str = "*") -> None:
    """A tab-separated result: fractions rounded, nulls as ``missing``."""
    columns = [F.coalesce((F.format_number(c, places) if t in ("double", "float") else F.col(c).cast("string")), F.lit(missing)).alias(c) for c, t in df.dtypes]
    columns = [F.regexp_replace(c, ",", "").alias(n) if t in ("double", "float") else c for c, (n, t) in zip(columns, df.dtypes, strict=True)]
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=True)
