"""Log files, directories and ZIP archives as numbered lines.

Plain files are read in splits, whatever their size. A first pass sums up each split: how many lines begin in it, whether
its bytes are UTF-8, and what its file begins with. From these few rows follow the number of the first line of each split,
and for each file whether it is binary and how it is decoded; the second pass numbers and decodes the lines. Members of ZIP
archives are dealt to tasks one by one and streamed.

Lines end at line feeds, carriage returns or both. Their order is that of (source_file, line_no). A file or member that
can't be read is a row whose line is null.
"""

from __future__ import annotations

import codecs
import io
import zipfile
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.session import shared_folder
from tessera.sources.paths import is_file

SNIFFED_BYTES, MOST_BINARY = 8192, 0.1
LINES = "line string, source_file string, line_no long"
#: Bytes (unpacked) of archive members for a task, about; and lines in a batch.
TASK_BYTES, BATCH = 64 << 20, 10_000
PRINTABLE = np.zeros(256, bool)
PRINTABLE[[*range(0x20, 0x7F), 9, 10, 13]] = True


def has_log_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(fixed.LOG_EXTENSIONS)


def stored(df: DataFrame) -> DataFrame:
    """A small table in the shared folder, so that it is worked out once."""
    path = f"{shared_folder(df.sparkSession)}/lines-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Plain files.


def rows_of_splits(spark: SparkSession, path: str) -> DataFrame:
    """value (what stands between line feeds), source_file, block (where its split begins), at (order in the task) and size."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    name = F.col("_metadata.file_path")
    wanted = ~F.lower(name).endswith(".zip")
    wanted = wanted if is_file(spark, path) else wanted & has_log_name(name)
    return raw.filter(wanted).select("value", name.alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size"))


def without_end(value: Column) -> Column:
    """A carriage return before a line feed belongs to the end of the line."""
    return F.when(value.endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(value)


SPLITS = "source_file string, block long, first long, n long, more long, utf8 boolean, size long, head binary"


def summed_up(rows: DataFrame) -> DataFrame:
    """One row with SPLITS for each split: lines, further lines by lone carriage returns, and the bytes of the file's first ones."""
    own = without_end(F.col("value"))
    more = F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\r")))
    head = F.when(F.col("block") < SNIFFED_BYTES, F.substring(F.col("value").cast("binary"), 1, SNIFFED_BYTES))
    narrow = rows.select("source_file", "block", "at", "size", more.alias("more"), F.is_valid_utf8("value").alias("utf8"), head.alias("head"))

    names_of = ["source_file", "block", "first", "n", "more", "utf8", "size", "head"]
    types = pa.schema(list(zip(names_of, [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.binary()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total, begin = None, None, bytearray()

        def row() -> pa.RecordBatch:
            made = {"source_file": split[0], "block": split[1], **total, "head": bytes(begin[:SNIFFED_BYTES]) if split[1] < SNIFFED_BYTES else None}
            return pa.RecordBatch.from_pylist([{c: made[c] for c in names_of}], types)

        for batch in batches:
            names, blocks = batch.column("source_file"), batch.column("block").to_numpy()
            codes = names.dictionary_encode().indices.to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                key = (names[a].as_py(), int(blocks[a]))
                if key != split:
                    if split is not None:
                        yield row()
                    split, begin = key, bytearray()
                    total = {"first": batch.column("at")[a].as_py(), "n": 0, "more": 0, "utf8": True, "size": batch.column("size")[a].as_py()}
                total["n"] += b - a
                total["more"] += int(batch.column("more").slice(a, b - a).to_numpy().sum())
                total["utf8"] &= all(batch.column("utf8").slice(a, b - a).to_pylist())
                if key[1] < SNIFFED_BYTES:
                    for k in range(a, b):
                        if len(begin) >= SNIFFED_BYTES:
                            break
                        begin += batch.column("head")[k].as_py() + b"\n"
        if split is not None:
            yield row()

    return narrow.mapInArrow(run, SPLITS)


def placed(splits: DataFrame) -> DataFrame:
    """Splits of text files, with the number of lines before each and whether its file is UTF-8."""
    in_file = Window.partitionBy("source_file")
    lines = F.col("n") + F.col("more")
    heads = F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("block", "head"))).over(in_file))
    begin = F.aggregate(heads, F.lit(b""), lambda all_, x: F.concat(all_, x["head"]))
    text = F.decode(F.substring(begin, F.lit(1), F.least(F.lit(SNIFFED_BYTES), F.col("size")).cast("int")), "ISO-8859-1")
    odd = F.length(F.regexp_replace(text, r"[\x20-\x7E\t\n\r]", ""))
    before = F.sum(lines).over(in_file.orderBy("block")) - lines
    made = splits.select("source_file", "block", "first", "more", before.alias("before"), F.min("utf8").over(in_file).alias("utf8"), text.alias("text"), odd.alias("odd"))
    return made.filter(F.col("odd") <= F.length("text") * MOST_BINARY).drop("text", "odd")


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, source_file and line_no (from 1, blank lines included) of the text files at ``path``."""
    rows = rows_of_splits(spark, path)
    known = stored(placed(stored(summed_up(rows))))
    found = rows.drop("size").join(known, ["source_file", "block"])
    # Both passes see the same splits; rows that don't fit what was summed up are an error, not a wrong number.
    fits = (F.col("at") >= F.col("first")) & (F.shiftright("at", 33) == F.shiftright("first", 33))
    nth = F.when(fits, F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("the files or their splits have changed")).cast("long"))
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    own = found.withColumn("value", text).withColumn("value", without_end(F.col("value")))
    usual = own.filter("more = 0").select(F.col("value").alias("line"), "source_file", (F.col("before") + nth + 1).alias("line_no"))
    # Splits with lone carriage returns: a line feed's row may be several lines. A window holds one split.
    pieces = own.filter("more > 0").withColumn("pieces", F.split("value", "\r", -1))
    until = F.sum(F.size("pieces")).over(Window.partitionBy("source_file", "block").orderBy("at"))
    several = pieces.withColumn("start", F.col("before") + until - F.size("pieces")).select("source_file", "start", F.posexplode("pieces").alias("k", "line"))
    return usual.unionByName(several.select("line", "source_file", (F.col("start") + F.col("k") + 1).alias("line_no")))


# Archives.

UNREADABLE = (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError, ValueError)


def opened(path: str):
    """A file to seek in, in any store that Arrow knows."""
    uri = path if "://" in path or ":" not in path else path.replace(":/", ":///", 1)
    store, own = fs.FileSystem.from_uri(uri)
    return store.open_input_file(own)


def members(archives: DataFrame) -> DataFrame:
    """path, member and size of what the archives hold, from their directories alone; a null member where one can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as file, zipfile.ZipFile(file) as archive:
                        found = [{"path": path, "member": m.filename, "size": m.file_size} for m in archive.infolist() if not m.is_dir()]
                except UNREADABLE:
                    found = [{"path": path, "member": None, "size": 0}]
                yield pa.RecordBatch.from_pylist(found, pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64())]))

    return archives.select("path").mapInArrow(run, "path string, member string, size long")


def member_text(archive: zipfile.ZipFile, member: str) -> str | None:
    """The encoding of a member's text, or None for a binary one; reads it once, so that a damaged one fails here."""
    decoder, encoding, begin = codecs.getincrementaldecoder("utf-8")(), "utf-8", b""
    with archive.open(member) as stream:
        while chunk := stream.read(1 << 20):
            begin = begin or chunk[:SNIFFED_BYTES]
            if encoding == "utf-8":
                try:
                    decoder.decode(chunk)
                except UnicodeDecodeError:
                    encoding = "latin-1"
    try:
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        encoding = "latin-1"
    odd = int((~PRINTABLE[np.frombuffer(begin, np.uint8)]).sum())
    return None if odd > MOST_BINARY * len(begin) else encoding


def lines_of_member(path: str, member: str | None) -> Iterator[tuple[str | None, int]]:
    """(line, number) of a member; one null line if it can't be read."""
    try:
        if member is None:
            raise zipfile.BadZipFile
        with opened(path) as file, zipfile.ZipFile(file) as archive:
            encoding = member_text(archive, member)
            if encoding is not None:
                with archive.open(member) as stream:
                    for k, line in enumerate(io.TextIOWrapper(stream, encoding, newline=None), 1):
                        yield line.removesuffix("\n"), k
    except UNREADABLE:
        yield None, 0


def archived_lines(spark: SparkSession, path: str) -> DataFrame:
    """LINES of the log files in the ZIP archives at ``path``; members are dealt to tasks, each is streamed."""
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").filter(F.lower("path").endswith(".zip"))
    found = stored(members(archives).filter(F.col("member").isNull() | has_log_name(F.coalesce("member", F.lit("")))))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("line", pa.string()), ("source_file", pa.string()), ("line_no", pa.int64())])
        for batch in batches:
            for own, member in zip(batch.column("path").to_pylist(), batch.column("member").to_pylist(), strict=True):
                name, held = own if member is None else f"{own}!/{member}", []
                for line, k in lines_of_member(own, member):
                    held.append({"line": line, "source_file": name, "line_no": k})
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held = []
                yield pa.RecordBatch.from_pylist(held, types)

    tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    return found.repartition(tasks, "path", "member").mapInArrow(run, LINES)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """LINES of one file of any name, of a ZIP archive, or of a directory of log files and archives."""
    return plain_lines(spark, path).unionByName(archived_lines(spark, path))


def read_split_logs(spark: SparkSession, path: str) -> DataFrame:
    """``read_logs`` without archives."""
    return plain_lines(spark, path)
