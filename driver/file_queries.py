"""Queries over log files that are written from the tables first, and over what a job writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import logspark as ls
from driver import derived_lines as D
from driver.derived_files import file_number, log_files, work, write_files
from logspark.fixed_values import CSV_HEADERS
from logspark.operators import addresses, candidates, refinement, states
from logspark.operators import scalars as S
from logspark.operators import tallies as A
from logspark.plans.once import landed_at
from logspark.plans.two_pass import two_pass_report
from logspark.schema import RECORD_COLUMNS
from logspark.sources import sinks, text_logs, versions

Query = Callable[[SparkSession, str], DataFrame]


def _job(spark: SparkSession, sf_dir: str, output: bool = False, rejected: bool = False, **options):
    """A job over all files: (result, where the CSV is, where the rejected lines are)."""
    files, at = log_files(spark, sf_dir), work(spark)
    csv_at, bad_at = (f"{at}/csv" if output else None), (f"{at}/rejected" if rejected else None)
    return ls.run_job(spark, files, csv_at, bad_at, ls.JobOptions(**options), at), csv_at, bad_at


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"`{h}` string" for h in CSV_HEADERS)).options(header=True, escape='"').csv(path)


# --- files in, numbers and text out --------------------------------------------------------


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of all files with its file and line number."""
    result, _, _ = _job(spark, sf_dir)
    numbered = ls.with_line_numbers(result.records, result.landed, key_lines=128)
    return numbered.select(file_number().alias("file"), "lineno", *RECORD_COLUMNS)


def job_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected lines that a job writes."""
    _, _, at = _job(spark, sf_dir, rejected=True)
    return spark.read.text(at).select(F.col("value").alias("line"))


def job_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV that a job writes, sorted, read back."""
    _, at, _ = _job(spark, sf_dir, output=True, ordered=True)
    return _read_csv(spark, at)


def job_csv_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, gzipped, in scan order and as a version."""
    _, at, _ = _job(spark, sf_dir, output=True, gzip=True, versioned=True, partitions=4)
    return _read_csv(spark, versions.current(spark, at))


def job_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary without any output, from two passes over the landed records."""
    return _job(spark, sf_dir, two_pass=True)[0].scalars


def job_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summary from sketches states exactly."""
    from driver.query_set import EXACT_TOTALS

    return _job(spark, sf_dir, exact=False)[0].scalars.select(*EXACT_TOTALS, "percentiles_exact")


def hidden_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are gzip without being named so, and how many lines they hold."""
    files = log_files(spark, sf_dir)
    found = text_logs.gzip_without_suffix(spark, files)
    lines = ls.read_lines(spark, files)
    return lines.where(F.col("file").isin(found) if found else F.lit(False)).groupBy(
        file_number().alias("file")).agg(F.count("*").alias("lines"))


def csv_line_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends, quotes and commas inside values, through the CSV and back."""
    number = F.col("event_id").cast("string")
    inside = D.case(F.col("event_id") % 4, F.lit("\\n"), F.lit('\\"'), F.lit(","), F.lit("\\r\\n"))
    line = F.concat(F.lit('{"ts":"2024-02-03 04:05:06","url":"/a'), inside, F.lit("b/"), number, F.lit('","status":200}'))
    rows = ls.extract(ls.meaningful_lines(D.lines_of(spark, sf_dir, line)))
    at = f"{work(spark)}/csv"
    sinks.write_csv(ls.parsed(rows), at)
    # Values hold line ends, so files are not split; told CR LF, the reader would change those in values to LF.
    return spark.read.schema(", ".join(f"`{h}` string" for h in CSV_HEADERS)).options(
        header=True, escape='"', multiLine=True, lineSep="\n").csv(at).select(F.col("URL").alias("url"), F.col("Status").alias("status"))


def versioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers find before the first version, while the second is written, after it, and after a failure."""
    at, seen = f"{work(spark)}/out", []
    events = D.events(spark, sf_dir).select("event_id")

    def look(step: str) -> None:
        place = versions.current(spark, at)
        seen.append((step, None) if place is None else (step, spark.read.parquet(place).count()))

    look("before")
    with versions.published(spark, at) as place:
        events.where("event_id % 2 = 0").write.parquet(place)
        look("first written")
    look("first published")
    with versions.published(spark, at) as place:
        events.write.parquet(place)
        look("second written")
    look("second published")
    try:
        with versions.published(spark, at) as place:
            events.limit(0).write.parquet(place)
            raise OSError("no third")
    except OSError:
        look("third failed")
    return spark.createDataFrame(seen, "step string, n long")


def file_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether dates without a year get the latest that does not lie a day or more after the file was written."""
    at = work(spark)
    stamp = F.date_format("ts", "MMM d HH:mm:ss")
    lines = D.with_parts(D.events(spark, sf_dir)).select(
        F.floor(F.col("event_id") / 5000).alias("file"), F.col("event_id").alias("pos"),
        F.concat(stamp, F.lit(" INFO event "), F.col("event_id").cast("string")).alias("line"))
    write_files(lines, f"{at}/plain")
    rows = ls.read_lines(spark, f"{at}/*/*/part-*")
    rows = ls.extract(ls.meaningful_lines(rows.withColumn("event_id", F.regexp_extract("line", "([0-9]+)$", 1).cast("long"))))
    date, latest = F.col("date").cast("timestamp_ntz"), F.col("file_mtime") + F.expr("INTERVAL 1 DAY")
    fits = (F.to_timestamp_ntz(F.concat_ws(" ", "date", "time")) <= latest) & (date + F.expr("INTERVAL 370 DAY") > F.col("file_mtime"))
    return rows.select("event_id", fits.alias("fits"))


# --- own layouts and redactors -----------------------------------------------------------------


def own_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in a layout that is added to the known ones."""
    line = F.concat_ws("|", F.lit("v1"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "ip", F.concat("method", F.lit(" "), "url"),
                       "status", "took")
    line = F.when(D.event_id() % 10 == 0, D.fixed8_line()).otherwise(line)
    mine = ls.RegexLayout("pipes", r"v1\|(?<ts>[^|]+)\|(?<ip>[^|]+)\|(?<request>[^|]+)\|(?<status>\d{3})\|"
                                   r"(?<duration>[0-9.]+) ?(?<unit>ms|s)")
    rows = ls.extract(ls.meaningful_lines(D.lines_of(spark, sf_dir, line)), layouts=(mine, *ls.DEFAULT_LAYOUTS))
    return rows.where(F.col("format") == "pipes").select(F.col("pos").alias("event_id"), *RECORD_COLUMNS)


def redact_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The redactor that changes nothing."""
    rows = ls.process(D.mixed_lines(spark, sf_dir), ls.JobOptions(redact=ls.keep))
    return rows.where("format IS NOT NULL OR line IS NOT NULL").select(F.col("pos").alias("event_id"), "format", "ip", "url", "line")


# --- exact figures without a shuffle of keys -------------------------------------------------------


def _landed(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, str]:
    at = work(spark)
    rows = ls.process(D.mixed_lines(spark, sf_dir)).where("format IS NOT NULL OR line IS NOT NULL")
    return landed_at(rows.select(*columns) if columns else rows, "rows", at), at


def two_pass_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tallies of the report from sketched candidates and a second pass that counts them."""
    rows, at = _landed(spark, sf_dir)
    return two_pass_report(rows, work=at)[0]


def top_urls_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tallies of many keys, with sketches so small that most of their keys are not tracked."""
    rows, at = _landed(spark, sf_dir)
    top = candidates.two_pass_top_keys(rows, 4, at, tracked=512, tallies=("url", "probe_path"))
    return top.select("tally", "key", "n", "rank")


def latency_percentiles_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by counting buckets, then the cells of those that hold a rank."""
    rows, _ = _landed(spark, sf_dir, "duration_ms")
    found = refinement.refined_percentiles(rows.select(F.col("duration_ms").alias("value")), S.PERCENTILES)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(name) for name, v in found.items()])


def distinct_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses from bitmaps, others as text."""
    return addresses.distinct_addresses(ls.parsed(ls.process(D.mixed_lines(spark, sf_dir))))


# --- states that are kept and merged ------------------------------------------------------------------


def _by_file(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    lines = D.mixed_lines(spark, sf_dir).withColumn("file", F.concat(F.lit("log-"), (F.col("pos") % 3).cast("string")))
    at = work(spark)
    return landed_at(ls.process(lines).where("format IS NOT NULL OR line IS NOT NULL"), "rows", at), at


def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of three files from their states, and whether the estimated ones lie within their bounds."""
    rows, at = _by_file(spark, sf_dir)
    states_ = landed_at(states.totals_state(rows, ("file",)), "totals", at)
    one = states.read_totals(states.merge_totals(states_))
    exact = addresses.distinct_addresses(rows).select(F.col("unique_ips").alias("exact_ips"))
    files = states_.agg(F.count("*").alias("files"))
    both = one.unionByName(exact, allowMissingColumns=True).unionByName(files, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select(
        "files", "parsed", "skipped", "timed", "mean_ms", "rate_4xx", "rate_5xx", "probe_attempts", "probe_successes", "exact_ips",
        F.col("exact_ips").between(F.col("unique_ips_low"), F.col("unique_ips_high")).alias("holds"))


def merged_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact rank of every percentile estimated from merged states, against its bound."""
    rows, at = _by_file(spark, sf_dir)
    states_ = landed_at(states.totals_state(rows, ("file",)), "totals", at)
    one = states.read_totals(states.merge_totals(states_)).first()
    out = []
    for name, fraction in S.PERCENTILES.items():
        estimate = one[name]
        # All ranks that equal values share count as the estimate's.
        below, upto = rows.where("duration_ms IS NOT NULL").agg(
            F.count_if(F.col("duration_ms") < estimate), F.count_if(F.col("duration_ms") <= estimate)).first()
        wanted, off = fraction * one.timed, one.rank_error * one.timed
        out.append((name, one.timed, below - off <= wanted <= upto + off))
    return spark.createDataFrame(out, "name string, timed long, holds boolean")


def merged_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys of every tally the merged states of three files name, and whether all counts lie within their bounds."""
    rows, at = _by_file(spark, sf_dir)
    states_ = landed_at(states.top_state(rows, ("file",)), "top", at)
    found = states.read_top(states.merge_top(states_))
    exact = A.tally_counts(rows, candidates.MANY_KEYS).select("tally", "key", F.col("n").alias("exact"))
    both = found.join(exact, ["tally", "key"], "left")
    holds = F.abs(F.col("n") - F.coalesce("exact", F.lit(0))) <= F.col("error")
    return both.groupBy("tally").agg(F.count("*").alias("named"), F.every(holds).alias("holds"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    job_records, job_rejected, job_csv, job_csv_gzip, job_scalars, job_estimates, hidden_gzip, csv_line_feeds, versioned_output,
    file_years, own_layout, redact_keep, two_pass_tallies, top_urls_two_pass, latency_percentiles_refined, distinct_ips,
    merged_totals, merged_percentiles, merged_top_keys)}
