"""The whole job: files in; records, rejected lines and a report out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.redact import Redactor, keep
from logspark.functions.text import strip
from logspark.functions.timestamps import checked_offset
from logspark.operators.extract import extract
from logspark.operators.layouts import DEFAULT_LAYOUTS, Layout
from logspark.operators.probes import with_probe_columns
from logspark.operators.scalars import approx_scalars, scalars
from logspark.operators.tallies import approx_top_keys, tally_counts, top_keys
from logspark.plans.once import landed_at, work_directory
from logspark.plans.two_pass import two_pass_report
from logspark.schema import DERIVED_COLUMNS, RECORD_COLUMNS
from logspark.sources.sinks import write_csv, write_rejected
from logspark.sources.text_logs import read_lines, with_line_numbers
from logspark.sources.versions import delete

LANDED = ("file", "block_start", "pos", "line")


@dataclass(frozen=True)
class JobOptions:
    """What a run can be told.

    ``exact=False`` takes sketches for the report; ``two_pass`` makes the exact one
    from the landed records without shuffling all keys. ``partitions`` spreads lines
    of gzipped files. ``ordered`` sorts the CSV by file and line, so that its
    parts in name order have the rows in the order they were read. ``versioned``
    outputs are found by :func:`logspark.sources.versions.current`.
    """

    redact: Redactor = keep
    assume_tz: str | None = None
    reference_time: datetime | None = None
    layouts: Sequence[Layout] = field(default=DEFAULT_LAYOUTS)
    exact: bool = True
    two_pass: bool = False
    top: int = 10
    gzip: bool = False
    ordered: bool = False
    versioned: bool = False
    by_content: bool = True
    partitions: int | None = None

    def __post_init__(self):
        if self.assume_tz:
            checked_offset(self.assume_tz)


@dataclass(frozen=True)
class JobResult:
    """Datasets of a finished run; they read the landed table until :meth:`close`."""

    spark: SparkSession
    landed_at: str
    landed: DataFrame
    records: DataFrame
    rejected: DataFrame
    tallies: DataFrame
    scalars: DataFrame

    def close(self) -> None:
        delete(self.spark, self.landed_at)


def process(lines: DataFrame, options: JobOptions = JobOptions()) -> DataFrame:
    """Lines to records: extraction, redaction and probe columns, lazily.

    Blank lines and comments stay in as rows without line and format, since
    they count when lines are numbered; a row with a line but no format was
    rejected. Redaction comes before everything that is counted or written.
    """
    text = strip(F.col("line"))
    lines = lines.withColumn("line", text)
    meaningful = (F.col("line") != "") & ~F.col("line").startswith("#")
    lines = lines.withColumn("line", F.when(meaningful, F.col("line")))
    rows = extract(
        lines, "line", options.layouts, options.assume_tz, options.reference_time, rejected_text_only=True)
    if options.redact is not keep:
        rows = rows.withColumns({name: options.redact(F.col(name)) for name in ("ip", "url", "line")})
    return with_probe_columns(rows)


def report(
    rows: DataFrame, options: JobOptions = JobOptions(), counts_at: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(tallies, scalars)`` of processed rows; no scalars row if nothing parsed.

    With ``counts_at`` the counts both are derived from are written there
    first, so that the one large shuffle is not repeated for every figure.
    """
    rows = rows.where(F.col("format").isNotNull() | F.col("line").isNotNull())
    if options.exact:
        counts = tally_counts(rows)
        if counts_at:
            counts.write.partitionBy("tally").parquet(counts_at)
            counts = rows.sparkSession.read.schema(counts.schema).parquet(counts_at)
        landed = counts_at is not None
        tallies = top_keys(counts, options.top, landed).withColumn("exact", F.lit(True))
        one = scalars(counts, landed).withColumns(
            {"unique_ips_low": F.col("unique_ips"), "unique_ips_high": F.col("unique_ips")})
    else:
        tallies, one = approx_top_keys(rows, options.top), approx_scalars(rows)
    return tallies, one.where(F.col("parsed") > 0)


def run_job(
    spark: SparkSession,
    inputs: str | list[str],
    output: str | None = None,
    rejected_output: str | None = None,
    options: JobOptions = JobOptions(),
    work_dir: str | None = None,
) -> JobResult:
    """Read the logs once, land the records, and derive all outputs from them.

    Without ``output`` no CSV is written; without ``rejected_output`` the
    rejected lines are only counted. The regexes run in one pass that writes a
    columnar table; CSV, report and line numbers are computed from that table,
    which also survives the loss of executors.
    """
    work = work_directory(spark, work_dir)
    columns = [*LANDED, *RECORD_COLUMNS, *DERIVED_COLUMNS, "is_probe", "status_class"]
    try:
        lines = read_lines(spark, inputs, options.partitions, options.by_content)
        landed = landed_at(process(lines, options).select(*columns), "rows", work)
        records = landed.where(F.col("format").isNotNull())
        unread = landed.where(F.col("format").isNull() & F.col("line").isNotNull())
        rejected = with_line_numbers(unread, landed).select("file", "lineno", "line")
        if rejected_output:
            rejected = landed_at(rejected, "rejected", work)
            write_rejected(rejected, rejected_output, options.versioned)
        if output:
            write_csv(records.orderBy("file", "pos") if options.ordered else records, output, options.gzip, options.versioned)
        if options.exact and options.two_pass:
            tallies, one = two_pass_report(landed, options.top, work)
        else:
            tallies, one = report(landed, options, f"{work}/counts")
    except BaseException:
        delete(spark, work)
        raise
    return JobResult(spark, work, landed, records, rejected, tallies, one)
