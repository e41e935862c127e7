"""Reading text logs, and numbering their lines."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names by which the text source finds the codec itself.
CODEC_SUFFIXES = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")
#: Files whose first bytes are looked at at the same time.
OPEN_AT_ONCE = 32
#: Lines that share a key when their split is looked up.
KEY_LINES = 1 << 20
#: Lines of an unpacked file handed on at a time.
BATCH_LINES = 10_000
_LINES = "file string, block_start long, file_mtime timestamp_ntz, line string"


def gzip_without_suffix(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Files that begin like gzip but are not named so; the text source would take them for text.

    Two bytes are read of every file without a codec's name, none of the others.
    """
    path_of, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI

    def begins_as_gzip(path) -> bool:
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            return stream.read() == 0x1F and stream.read() == 0x8B
        finally:
            stream.close()

    files = [path_of(path_of(uri(f)).toString()) for f in spark.read.text(paths).inputFiles() if not f.endswith(CODEC_SUFFIXES)]
    with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
        found = [f for f, is_gzip in zip(files, pool.map(begins_as_gzip, files)) if is_gzip]
    return [f.toUri().toString() for f in found]  # as the files' metadata name them


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, file_mtime, content) of gzip files to their lines, in order."""
    def batch(file, mtime, lines):
        columns = [pa.array([file] * len(lines)), pa.array([0] * len(lines), pa.int64()),
                   pa.array([mtime] * len(lines), pa.timestamp("us")), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "block_start", "file_mtime", "line"])

    for rows in batches:
        for i in range(rows.num_rows):
            file, mtime, content = (rows.column(c)[i] for c in range(3))
            with gzip.open(io.BytesIO(content.as_buffer())) as raw, io.TextIOWrapper(raw, "utf-8", "replace") as text:
                held = []
                for line in text:
                    held.append(line.removesuffix("\n"))
                    if len(held) == BATCH_LINES:
                        yield batch(file.as_py(), mtime.as_py(), held)
                        held = []
                yield batch(file.as_py(), mtime.as_py(), held)


def read_lines(
    spark: SparkSession, paths: str | list[str], partitions: int | None = None, by_content: bool = True
) -> DataFrame:
    """``(file, block_start, file_mtime, pos, line)``, one row per physical line.

    Plain files are split among tasks; a ``.gz`` file is one task, so pass
    ``partitions`` to spread its lines afterwards. Files that are gzip inside
    without being named so are unpacked as well, each in one task that holds its
    packed bytes (at most 2 GB, by Spark), and come after the others; with
    ``by_content=False`` they are not looked for. Invalid UTF-8 is replaced, never
    fatal. ``pos`` increases along every file and is the same in every run over
    the same files.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"),
        F.make_valid_utf8("value").alias("line"),
    )
    if by_content and (hidden := gzip_without_suffix(spark, paths)):
        # Both filters are on files, which the sources then do not open.
        packed = spark.read.format("binaryFile").load(paths).where(F.col("_metadata.file_path").isin(hidden)).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"), "content")
        lines = lines.where(~F.col("file").isin(hidden)).unionByName(packed.mapInArrow(_unpacked, _LINES))
    lines = lines.select("file", "block_start", "file_mtime", F.monotonically_increasing_id().alias("pos"), "line")
    # By hash of the unique position: even, and the same again if a task is retried.
    return lines.repartition(partitions, "pos") if partitions else lines


def undecoded_gzip(lines: DataFrame) -> DataFrame:
    """Files that were read as text, with ``by_content=False``, though they are gzip inside.

    Only the first line of each file decides, but the files are scanned for it.
    """
    is_gzip = F.col("line").startswith("\x1f\ufffd")
    firsts = lines.where(F.col("block_start") == 0).groupBy("file").agg(
        F.min("pos").alias("first"), F.min(F.when(is_gzip, F.col("pos"))).alias("first_gzip"))
    return firsts.where(F.col("first") == F.col("first_gzip")).select("file")


def with_line_numbers(df: DataFrame, lines: DataFrame | None = None, key_lines: int = KEY_LINES) -> DataFrame:
    """Add ``lineno``, counted from 1 in every file, blanks and comments included.

    ``df`` holds some of the rows of ``lines`` (all, by default). Inside one
    split of a file ``pos`` has no gaps, so only the splits are counted and
    summed up, and no line is shuffled for it. They are looked up by ranges of
    ``key_lines`` positions, so a file in one split, however long, is many keys.
    The join is left to the optimizer, as the number of ranges grows with the data.
    """
    lines = df if lines is None else lines
    splits = lines.groupBy("file", "block_start").agg(
        F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    key = lambda pos: F.expr(f"{pos} div {int(key_lines)}L")
    splits = splits.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    splits = splits.select("file", "block_start", "_first", "_before", F.explode(
        F.sequence(key("_first"), key("(_first + _size - 1)"))).alias("_range"))
    numbered = df.withColumn("_range", key("pos")).join(splits, ["file", "block_start", "_range"])
    return numbered.select(
        *df.columns, (F.col("pos") - F.col("_first") + F.col("_before") + 1).alias("lineno"))
