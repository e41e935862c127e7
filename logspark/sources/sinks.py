"""Writing results: CSV of the records, text of the rejected lines.

Everything is written to a new directory first and put in place only when it
is complete, so a failed run leaves the previous output as it was.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.fixed_values import CSV_HEADERS
from logspark.operators.extract import csv_projection
from logspark.sources import versions
from logspark.sources.versions import file_system

LINE_END = "\r\n"


@contextmanager
def published(spark: SparkSession, path: str):
    """Yield a directory to write to; it becomes ``path`` if the block succeeds."""
    fs, to_path = file_system(spark, path)
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    staging, previous = f"{path}.staging-{mark}", f"{path}.previous-{mark}"
    try:
        yield staging
    except BaseException:
        fs.delete(to_path(staging), True)
        raise
    replaced = fs.exists(to_path(path))
    if replaced and not fs.rename(to_path(path), to_path(previous)):
        fs.delete(to_path(staging), True)
        raise OSError(f"could not move {path} aside")
    if not fs.rename(to_path(staging), to_path(path)):
        if replaced:
            fs.rename(to_path(previous), to_path(path))
        fs.delete(to_path(staging), True)
        raise OSError(f"could not put the new output in place at {path}")
    if replaced:
        fs.delete(to_path(previous), True)


def csv_line(records: DataFrame) -> Column:
    """A record as one CSV line: quoted where a value has a comma, a quote or a line end, NULL as nothing."""
    def field(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in records.columns])


def csv_text(records: DataFrame) -> DataFrame:
    """The lines of all part files: every partition begins with the header."""
    header = ",".join(CSV_HEADERS)
    line = csv_line(csv_projection(records))
    rows = csv_projection(records).select(line.alias("value"), F.monotonically_increasing_id().alias("id"))
    first = F.col("id") % (1 << 33) == 0
    return rows.select(F.when(first, F.concat(F.lit(header + LINE_END), "value")).otherwise(F.col("value")).alias("value"))


def write_csv(records: DataFrame, path: str, gzip: bool = False, versioned: bool = False) -> None:
    """The eleven columns with a header, one file per partition; without records, a header alone."""
    spark = records.sparkSession
    text = csv_text(records)
    if records.isEmpty():
        text = spark.range(1).select(F.lit(",".join(CSV_HEADERS)).alias("value"))
    with (versions.published if versioned else published)(spark, path) as staging:
        text.write.options(lineSep=LINE_END, compression="gzip" if gzip else "none").text(staging)


def rejected_text(rejected: DataFrame) -> DataFrame:
    """``line N: text`` for rows of ``(lineno, line)``."""
    return rejected.select(F.concat(
        F.lit("line "), F.col("lineno").cast("string"), F.lit(": "), F.col("line")).alias("value"))


def write_rejected(rejected: DataFrame, path: str, versioned: bool = False) -> bool:
    """Write the rejected lines in file order. Without any, an earlier output stays.

    ``rejected`` is read three times, to see whether it is empty, for the ranges of the
    sort and for the sort, so pass a written table.
    """
    if rejected.isEmpty():
        return False
    with (versions.published if versioned else published)(rejected.sparkSession, path) as staging:
        rejected_text(rejected.orderBy("file", "lineno")).write.text(staging)
    return True
