"""Files that must be read from their beginning: binary landmark files and tar archives.

Each file is one task's stream, read through Arrow's file systems; rows leave it as they are found, so a task holds a
record or a batch and not a file. Only the files' names go into the plan."""

from __future__ import annotations

import gzip
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import base_filter, circular_header
from ..operators.catalog import ENZYMES, SKETCH
from ..operators.series import contig_offsets
from ..session import materialise, ship
from .files import BadFile, read_tgt

# Fixed values of the binary landmark file: its mark, the versions read (the last is written), and its entry.
MARK, OLD_MARK, VERSIONS = b"TGT\x02", b"TGT\x01", (2, 3)
HEAD = "<4sIQIHH24x"
ENTRY = np.dtype([("seq", "S32"), ("gpos", "<u8"), ("enzyme", "u1"), ("strand", "u1"), ("contig_id", "<u2"), ("unused", "V4")])
SOURCES = [*ENZYMES, SKETCH]
BATCH = 65_536
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20

CONTIGS = "array<struct<name:string,length:long,circular:boolean>>"
ENTRY_ROWS = f"genome string, total long, contigs {CONTIGS}, ord long, gpos long, seq string, enzyme string, strand string, contig_id long"
RECORD_ROWS = "archive string, member string, n long, head string, body string"


def open_file(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def each_file(spark: SparkSession, path: str, rows: Callable[[str, BinaryIO], Iterator[dict[str, list]]], schema: str, glob: str | None = None) -> DataFrame:
    """``rows(file, stream)`` of every file under ``path``, each read whole by one task, which reads many small ones."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    names = (found.option("pathGlobFilter", glob) if glob else found).load(path).select("path", "length")
    many, size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(many, max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    spread = names.select("path").repartition(tasks, "path")
    arrow = pa.schema([(f.name, to_arrow(f.dataType.simpleString())) for f in _schema(spark, schema)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_file(name) as stream:
                    for part in rows(name, stream):
                        yield pa.RecordBatch.from_pydict(part, schema=arrow)

    return spread.mapInArrow(read, schema)


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def to_arrow(kind: str) -> pa.DataType:
    plain = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return plain.get(kind) or pa.list_(pa.struct([("name", pa.string()), ("length", pa.int64()), ("circular", pa.bool_())]))


def _exactly(stream: BinaryIO, many: int, what: str) -> bytes:
    data = stream.read(many)
    if len(data) != many:
        raise BadFile(f"landmark file ends within {what}")
    return data


def _name(stream: BinaryIO, what: str) -> str:
    return _exactly(stream, *struct.unpack("<H", _exactly(stream, 2, what)), what).decode("utf-8", "replace")


def binary_records(name: str, stream: BinaryIO) -> Iterator[dict[str, list]]:
    """Records one after the other. A record's entries, 48 bytes each, leave in batches; its contigs, which come last
    in the file, leave as a row of their own with a null ``ord``."""
    while True:
        head = stream.read(struct.calcsize(HEAD))
        if len(head) < struct.calcsize(HEAD):
            if head:
                raise BadFile(f"{name}: landmark file ends within a header")
            return
        mark, version, total, many, _, contigs = struct.unpack(HEAD, head)
        if mark == OLD_MARK:
            raise BadFile(f"{name}: landmark file of the obsolete version 1; write it anew")
        if mark != MARK or version not in VERSIONS:
            raise BadFile(f"{name}: not a landmark file of version 2 or 3")
        genome = _name(stream, "a series' name")
        last, stored = None, []
        for at in range(0, many, BATCH):
            size = min(BATCH, many - at)
            e = np.frombuffer(_exactly(stream, size * ENTRY.itemsize, "its entries"), ENTRY)
            if size and int(e["enzyme"].max()) >= len(SOURCES):
                raise BadFile(f"{name}: unknown landmark source {int(e['enzyme'].max())}")
            gpos = e["gpos"].astype(np.int64)
            step = np.diff(gpos, prepend=gpos[0] if last is None else last)
            stored.append(np.maximum(step, 0).astype(np.uint32)[1 if last is None else 0 :])
            last = gpos[-1]
            yield {
                "genome": [genome] * size, "total": [total] * size, "contigs": [None] * size, "ord": np.arange(at, at + size), "gpos": gpos, "seq": [s.decode("latin-1") for s in e["seq"].tolist()],
                "enzyme": [SOURCES[n] for n in e["enzyme"]], "strand": np.where(e["strand"] == 0, "+", "-").tolist(), "contig_id": e["contig_id"].astype(np.int64),
            }
        for gap in stored:
            if np.frombuffer(_exactly(stream, 4 * len(gap), "its gaps"), "<u4").tobytes() != gap.astype("<u4").tobytes():
                raise BadFile(f"{name}: stored gap differs from the places of {genome}")
        names = [_name(stream, "a contig's name") for _ in range(contigs)]
        flags = _exactly(stream, contigs, "its contigs' shapes") if version >= 3 else bytes(contigs)
        listed = [{"name": c, "length": None, "circular": bool(f)} for c, f in zip(names, flags, strict=True)]
        yield {"genome": [genome], "total": [total], "contigs": [listed], "ord": [None], "gpos": [None], "seq": [None], "enzyme": [None], "strand": [None], "contig_id": [None]}


def read_binary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Binary landmark files as ``read_tgt`` gives text ones: series ``genome, length, contigs`` and landmarks. Versions
    2 and 3; a file of version 1, a damaged one and one whose gaps disagree with its places are errors. Lengths of
    contigs aren't stored and are null. Contig 0 has no name."""
    rows = materialise(each_file(spark, path, binary_records, ENTRY_ROWS), "entries")
    series = rows.filter("ord IS NULL").select("genome", F.col("total").alias("length"), "contigs")
    named = series.select("genome", F.posexplode("contigs").alias("n", "c")).select("genome", (F.col("n") + 1).cast("long").alias("contig_id"), F.col("c.name").alias("contig_name"))
    marks = rows.filter("ord IS NOT NULL").join(named, ["genome", "contig_id"], "left")
    return series, marks.select("genome", "contig_id", "ord", "gpos", "seq", "enzyme", "strand", "contig_name")


def is_binary(spark: SparkSession, path: str) -> DataFrame:
    """``file, binary`` of every file, told by its first four bytes."""
    def sniff(name: str, stream: BinaryIO) -> Iterator[dict[str, list]]:
        yield {"file": [name], "binary": [stream.read(4)[:3] == MARK[:3]]}

    return each_file(spark, path, sniff, "file string, binary boolean")


def read_landmark_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landmark files of a folder, text and binary ones told apart by their contents, not their names. The list of
    names passes the driver, as any list of input files does."""
    kinds: dict[bool, list[str]] = {True: [], False: []}
    for r in is_binary(spark, path).collect():
        kinds[r["binary"]].append(r["file"])
    if not kinds[True] and not kinds[False]:
        raise BadFile(f"no landmark files in {path}")
    read = {True: read_binary, False: read_tgt}
    parts = [read[k](spark, v) for k, v in kinds.items() if v]
    if len(parts) == 1:
        return parts[0]
    return tuple(a.unionByName(b) for a, b in zip(*parts, strict=True))


def write_binary(landmarks: DataFrame, series: DataFrame, path: str) -> DataFrame:
    """A binary landmark file a series under ``path``; gives ``genome, file, bytes``.

    Landmarks need ``genome, contig_id, ord, gpos, seq, enzyme, strand``; letters beyond 32 don't fit and are cut.
    A series is one file, so one stream, but what a task holds of it is a batch and 4 bytes a landmark. A file
    appears under its name when it is whole, so a task tried again does no harm."""
    spark = landmarks.sparkSession
    ship(spark)
    target = path if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) else f"file://{path}"
    sizes = landmarks.groupBy("genome").agg(F.count(F.lit(1)).alias("many"), F.countDistinct("enzyme").alias("sources"))
    heads = series.select("genome", "length", "contigs").join(sizes, "genome", "left").select(
        "genome", F.lit(-1).cast("long").alias("ord"), F.col("length").alias("gpos"), F.lit(None).cast("string").alias("seq"), F.lit(None).cast("string").alias("enzyme"), F.lit(None).cast("string").alias("strand"),
        F.lit(0).cast("long").alias("contig_id"), F.coalesce("many", F.lit(0)).alias("many"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce(F.transform("contigs", lambda c: c["name"]), F.array().cast("array<string>")).alias("names"),
        F.coalesce(F.transform("contigs", lambda c: F.coalesce(c["circular"], F.lit(False))), F.array().cast("array<boolean>")).alias("circular"),
    )
    place = F.row_number().over(Window.partitionBy("genome").orderBy("ord")).cast("long")
    body = landmarks.select("genome", place.alias("ord"), "gpos", "seq", "enzyme", "strand", "contig_id").join(series.select("genome"), "genome", "left_semi")
    # written first: a union whose sides have each been partitioned by series may be taken as partitioned itself
    rows = materialise(heads.unionByName(body, allowMissingColumns=True), "entries").repartition("genome").sortWithinPartitions("genome", "ord")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(target)
        system.create_dir(folder, recursive=True)
        open_: dict = {}

        def close() -> pa.RecordBatch:
            out, head, gaps = open_["out"], open_["head"], open_["gaps"]
            out.write(b"".join(gaps))
            for n in head["names"]:
                raw = n.encode()
                out.write(struct.pack("<H", len(raw)) + raw)
            out.write(bytes(head["circular"]))
            size = out.tell()
            out.close()
            system.move(open_["part"], open_["name"])
            return pa.RecordBatch.from_pydict({"genome": [head["genome"]], "file": [open_["name"]], "bytes": [size]})

        for batch in batches:
            genomes = batch.column("genome").to_pylist()
            cuts = [n for n in range(len(genomes)) if n == 0 or genomes[n] != genomes[n - 1]] + [len(genomes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if part.column("ord")[0].as_py() == -1:
                    if open_:
                        yield close()
                    head = part.slice(0, 1).to_pylist()[0]
                    raw = head["genome"].encode()
                    if len(head["names"]) > 65_535:
                        raise BadFile(f"{head['genome']}: {len(head['names'])} contigs, 65,535 fit into a landmark file")
                    safe = re.sub(r"[^A-Za-z0-9.-]", "_", head["genome"])
                    name = f"{folder}/s{safe}-{zlib.crc32(raw):08x}.tgt"
                    open_.update(head=head, gaps=[], last=None, name=name, part=f"{folder}/_{uuid.uuid4().hex}")
                    open_["out"] = system.open_output_stream(open_["part"])
                    open_["out"].write(struct.pack(HEAD, MARK, VERSIONS[-1], head["gpos"] or 0, head["many"], head["sources"], len(head["names"])) + struct.pack("<H", len(raw)) + raw)
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                e = np.zeros(part.num_rows, ENTRY)
                contig = part.column("contig_id").to_numpy(zero_copy_only=False)
                if contig.max() > 65_535:
                    raise BadFile(f"{open_['head']['genome']}: contig {int(contig.max())} doesn't fit into a landmark file")
                gpos = part.column("gpos").to_numpy(zero_copy_only=False)
                e["seq"] = np.array([s.encode() for s in part.column("seq").to_pylist()], "S32")
                e["gpos"], e["contig_id"] = gpos, contig
                e["enzyme"] = [SOURCES.index(s) for s in part.column("enzyme").to_pylist()]
                e["strand"] = [s == "-" for s in part.column("strand").to_pylist()]
                step = np.maximum(np.diff(gpos, prepend=gpos[0] if open_["last"] is None else open_["last"]), 0)
                open_["gaps"].append(step[1 if open_["last"] is None else 0 :].astype("<u4").tobytes())
                open_["last"] = gpos[-1]
                open_["out"].write(e.tobytes())
        if open_:
            yield close()

    return materialise(rows.mapInArrow(write, "genome string, file string, bytes long"), "written")


def archived_records(pattern: str) -> Callable[[str, BinaryIO], Iterator[dict[str, list]]]:
    """Reads the members of a tar archive whose base name fits, one after the other, into their ``>`` records."""
    fits = re.compile(pattern)

    def read(archive: str, stream: BinaryIO) -> Iterator[dict[str, list]]:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for member in tar:
                if not member.isfile() or not fits.search(member.name.rsplit("/", 1)[-1]):
                    continue
                inner = tar.extractfile(member)
                lines = gzip.open(inner) if member.name.endswith(".gz") else inner
                n, head, body = 0, None, []
                row = lambda: {"archive": [archive], "member": [member.name], "n": [n], "head": [head], "body": [b"".join(body).decode("latin-1")]}  # noqa: E731, B023
                for line in lines:
                    if line.startswith(b">"):
                        if head is not None:
                            yield row()
                            n += 1
                        head, body = line[1:].rstrip(b"\r\n").decode("utf-8", "replace"), []
                    elif head is None and line.strip():
                        raise BadFile(f"{archive}, {member.name}: text before the first header")
                    else:
                        body.append(line.rstrip(b"\r\n"))
                if head is not None:
                    yield row()

    return read


def read_archives(spark: SparkSession, path: str, wanted: DataFrame | None = None, pattern: str = r"\.(fa|fna|fasta)(\.gz)?$", glob: str | None = None) -> DataFrame:
    """Sequences of the members of tar archives (plain, gzip, bzip2 or xz), members themselves plain or gzip: the
    columns of ``read_fasta``, and ``archive``. A member is one series, named by its base name. ``wanted``
    (``genome``): only those. Of a series in several archives, the first archive's first counts.

    An archive is one stream, read once; a record leaves the task as soon as it ends, so what is held is the
    longest record."""
    records = each_file(spark, path, archived_records(pattern), RECORD_ROWS, glob)
    rows = records.select(
        F.regexp_replace(F.element_at(F.split("member", "/"), -1), pattern, "").alias("genome"), "archive", "member", "n", F.rtrim("head").alias("head"), "body",
    )
    if wanted is not None:
        rows = rows.join(wanted.select("genome").distinct(), "genome", "left_semi")
    rows = materialise(rows, "members")
    first = rows.groupBy("genome").agg(F.min(F.struct("archive", "member")).alias("_first")).select(F.col("genome").alias("_g"), "_first.archive", "_first.member").withColumnsRenamed({"archive": "_a", "member": "_m"})
    rows = rows.join(first, (F.col("genome") == F.col("_g")) & (F.col("archive") == F.col("_a")) & (F.col("member") == F.col("_m")), "left_semi")
    head: Column = F.col("head")
    out = rows.select(
        "genome", "archive", (F.col("n") + 1).alias("contig_id"), F.split_part(head, F.lit(" "), F.lit(1)).alias("contig_name"),
        F.nullif(F.regexp_extract(head, r"^[^ ]* (.*)$", 1), F.lit("")).alias("description"), circular_header(head).alias("circular"), base_filter(F.col("body")).alias("seq"),
    )
    return contig_offsets(out.withColumn("length", F.length("seq").cast("long")))


def archive_report(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``genome, archive`` of every wanted series; the archive is null where none holds it."""
    return wanted.select("genome").distinct().join(found.select("genome", "archive").distinct(), "genome", "left")
