"""The same extraction over a directory that keeps receiving log files.

Every step from line to record looks at one line only, so it applies to a
stream unchanged; numbering and reports belong to the batch job.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.extract import extract, meaningful_lines
from logspark.plans.job import JobOptions


def stream_records(spark: SparkSession, directory: str, options: JobOptions = JobOptions()) -> DataFrame:
    """A streaming DataFrame of records and rejected lines (``format`` NULL)."""
    lines = spark.readStream.text(directory).select(
        F.make_valid_utf8("value").alias("line"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"))
    rows = extract(
        meaningful_lines(lines), "line", options.layouts, options.assume_tz, options.reference_time)
    return rows.withColumns({name: options.redact(F.col(name)) for name in ("ip", "url", "line")})
