"""FASTA and FASTQ scans, manifests and file discovery.

Files are streamed: a task holds one batch of records and never a file. Plain files are cut
into splits by offset, packed ones are read by one task each. Paths may be of any file
system that Arrow knows.
"""

from __future__ import annotations

import bz2
import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename

SCHEMA = "file string, pos bigint, id string, seq string, failed boolean"
#: Bytes of a split, of a read, and letters of a batch.
SPLIT, CHUNK, BATCH = 128 << 20, 1 << 20, 4 << 20
#: Positions of a split are counted above these bits.
SPLIT_BITS = 40


class Broken(Exception):
    """A file that is neither FASTA nor FASTQ, or breaks off."""


def _open(path: str, seekable: bool = False):
    local = re.fullmatch(r"file:/*(/.*)", path)
    at, name = (fs.LocalFileSystem(), local.group(1)) if local else (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    raw = at.open_input_file(name) if seekable else at.open_input_stream(name, compression=None)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if path.endswith(".bz2") else raw


def _lines(stream, offset: int = 0) -> Iterator[tuple[int, str]]:
    """Lines with the offset of their beginning, in chunks of bounded size."""
    rest = b""
    while chunk := stream.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield offset, line.decode("utf-8", "replace").rstrip("\r")
            offset += len(line) + 1
    if rest:
        yield offset, rest.decode("utf-8", "replace").rstrip("\r")


def _synchronised(lines: Iterator[tuple[int, str]], fastq: bool) -> Iterator[tuple[int, str]]:
    """From the first record on. A quality line that begins like a header is none, since
    no line of letters two further begins with a plus."""
    held: list[tuple[int, str]] = []
    for at, line in lines:
        if not fastq:
            if line.startswith(">"):
                held = [(at, line)]
                break
            continue
        held.append((at, line))
        if len(held) > 2 and held[-3][1].startswith("@") and line.startswith("+"):
            held = held[-3:]
            break
    else:
        return
    yield from held
    yield from lines


def records(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[str, str]]:
    """The (id, sequence) records of a FASTA or FASTQ file whose header begins in
    [start, end). Raises `Broken` where the file breaks off."""
    try:
        stream = _open(path, seekable=start > 0)
        lines = _lines(stream)
        if start:
            fastq = stream.read(CHUNK).lstrip()[:1] == b"@"
            stream.seek(start - 1)
            lines = _lines(stream, start - 1)
            next(lines, None)  # the rest of a line that began before
            lines = _synchronised(lines, fastq)
        now = next(lines, None)
        while now is not None and (end is None or now[0] < end):
            line = now[1]
            if not line.strip():
                now = next(lines, None)
            elif line[0] == ">":
                part = []
                while (now := next(lines, None)) is not None and not now[1].startswith(">"):
                    part.append(now[1].strip())
                yield line[1:].strip(), "".join(part)
            elif line[0] == "@":
                seq, plus, quality = (next(lines, (0, None))[1] for _ in range(3))
                if quality is None or not plus.startswith("+") or len(seq) != len(quality):
                    raise Broken(path)
                yield line[1:].strip(), seq.strip()
                now = next(lines, None)
            else:
                raise Broken(path)
    except (OSError, EOFError, zlib.error) as e:
        raise Broken(path) from e


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_RECORDS = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("failed", pa.bool_())])
_PAIRS = pa.schema([("prefix", pa.string()), ("file", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("seq", pa.string()), ("seq2", pa.string())])


def _splits(spark: SparkSession, paths: str | list[str], recursive: bool, extension: str | None, size: int) -> DataFrame:
    """`file, split, start, end`, each row in a task of its own where there are few."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if extension:
        r = r.option("pathGlobFilter", f"*{extension}")
    files = r.load(paths).filter("length > 0").select("path", "length")
    packed = F.col("path").rlike(r"\.(gz|bz2)$")
    n = F.when(packed | F.lit(size <= 0), F.lit(1)).otherwise(F.ceil(F.col("length") / F.lit(max(1, size))))
    one = files.withColumn("n", n.cast("int")).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("split").cast("bigint") * F.lit(size)
    cut = one.select(F.col("path").alias("file"), "split", start.alias("start"), F.when(F.col("n") > 1, start + F.lit(size)).alias("end"))
    tasks = cut.count()  # of a listing
    return cut.repartition(min(tasks, 20_000), "file", "split") if tasks else cut


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = False, extension: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """`file, pos, id, seq, failed`: all records, and one row without id and sequence where
    a file breaks off, behind the records before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for file, split, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    pos = split << SPLIT_BITS
                    try:
                        for name, seq in records(file, start, end):
                            yield file, pos, name, seq, False
                            pos += 1
                    except Broken:
                        yield file, pos, None, None, True

        yield from _batches(rows(), _RECORDS)

    return _splits(spark, paths, recursive, extension, split_bytes).mapInArrow(read, SCHEMA)


def read_sequences(spark: SparkSession, paths: str | list[str], keep_partial: bool = False, recursive: bool = False, extension: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """`file, pos, id, seq` of FASTA/FASTQ files, plain, gzip or bzip2.

    A file that breaks off contributes nothing (which takes a second pass that looks for
    such files), or with `keep_partial` the records before the error. Ids may repeat;
    (file, pos) is unique and ordered as in the file, and without splits (`split_bytes` 0,
    packed files) it is the record's number. Empty files give no rows.
    """
    rows = scan(spark, paths, recursive, extension, split_bytes)
    if not keep_partial:
        rows = rows.join(rows.filter("failed").select("file").distinct(), "file", "left_anti")
    return rows.filter("NOT failed").select("file", "pos", "id", "seq")


def totals(rows: DataFrame, least: int = 0, listed: DataFrame | None = None) -> DataFrame:
    """One row of build totals over `scan`: `files, invalid_files, sequences,
    skipped_sequences, length_bp`. Sequences below `least` letters are skipped. Files of
    `listed` (column file) without any row are invalid: missing or empty."""
    big = F.col("failed").eqNullSafe(False) & (F.length("seq") >= least)
    per = rows.groupBy("file").agg(
        F.count(F.when(big, 1)).alias("sequences"), F.count(F.when(~F.col("failed") & ~big, 1)).alias("skipped"), F.sum(F.when(big, F.length("seq"))).alias("bp"), F.max("failed").alias("bad")
    )
    if listed is not None:
        per = listed.select(F.col("file").alias("__f")).distinct().join(per, F.col("__f") == F.col("file"), "left")
    bad = F.col("bad").isNull() | F.col("bad")
    zero = F.lit(0).cast("bigint")
    return per.agg(
        F.count(F.when(~bad, 1)).alias("files"), F.count(F.when(bad, 1)).alias("invalid_files"),
        *[F.coalesce(F.sum(c), zero).alias(n) for c, n in (("sequences", "sequences"), ("skipped", "skipped_sequences"), ("bp", "length_bp"))],
    )


def read_batches(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """`prefix, file, pos, id, seq, seq2` of a batch manifest (`prefix, file1, file2`).

    Both files of a pair are streamed side by side and joined by position; the id is mate
    1's, and a missing second mate is null. Records before an error are kept. Prefixes
    and files may repeat; (file, pos) is unique. A missing file is an error.
    """
    numbered = manifest.withColumn("__n", F.row_number().over(Window.orderBy("prefix", "file1", "file2")))  # a list of files
    tasks = max(1, min(numbered.count(), 20_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for prefix, one, two, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    for file in (one, two):
                        if file:
                            _open(file).close()
                    second = records(two) if two else iter(())
                    pos = n << SPLIT_BITS
                    try:
                        for name, seq in records(one):
                            try:
                                mate = next(second, None)
                            except Broken:
                                mate, second = None, iter(())
                            yield prefix, one, pos, name, seq, mate[1] if mate else None
                            pos += 1
                    except Broken:
                        continue

        yield from _batches(rows(), _PAIRS)

    return numbered.select("prefix", "file1", "file2", "__n").repartition(tasks, "__n").mapInArrow(read, "prefix string, file string, pos bigint, id string, seq string, seq2 string")


def long_enough(seqs: DataFrame, least: int) -> DataFrame:
    return seqs.filter(F.length("seq") >= least)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """`prefix, file1, file2` of a tab-separated batch file; prefixes may repeat. Rows
    with fewer than two fields raise an error when read."""
    rows = spark.read.csv(path, sep="\t", schema="prefix string, file1 string, file2 string")
    return rows.withColumn("file1", F.when(F.col("file1").isNull(), F.raise_error(F.lit("a batch needs a prefix and a file"))).otherwise(F.col("file1")))


def read_build_manifest(spark: SparkSession, path: str) -> DataFrame:
    """`file, target`; the target is the file's name where it is missing. Further columns
    are ignored."""
    rows = spark.read.csv(path, sep="\t", schema="file string, target string, more string")
    return rows.select("file", F.coalesce("target", basename(F.col("file"))).alias("target"))


def read_input_file(spark: SparkSession, path: str, by_file: bool = True) -> DataFrame:
    """`file, target, node, specialization, specialization_name`, one to five columns.
    If no row has a target and targets are files, the file's name is the target."""
    rows = spark.read.csv(path, sep="\t", schema="file string, target string, node string, specialization string, specialization_name string")
    if not by_file:
        return rows
    none = rows.agg(F.count("target").alias("n")).select("n").scalar() == 0
    return rows.withColumn("target", F.when(none, basename(F.col("file"))).otherwise(F.col("target")))


def list_files(spark: SparkSession, paths: str | list[str], extension: str, recursive: bool = False) -> DataFrame:
    """Distinct non-empty files below `paths` whose names end in `extension`."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(paths).filter("length > 0").select(F.col("path").alias("file")).distinct()
