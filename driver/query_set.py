"""The queries the driver runs, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driver import derived_lines as D
from driver.derived_lines import event_id
from logspark.functions import fields as X
from logspark.functions import redact as R
from logspark.functions.timestamps import with_timestamp
from logspark.functions.urls import is_suspicious, path_segments
from logspark.operators import scalars as S
from logspark.operators import tallies as A
from logspark.operators.extract import csv_projection, extract, meaningful_lines, parsed, rejected
from logspark.operators.probes import with_probe_columns
from logspark.plans.job import JobOptions, process, report
from logspark.schema import RECORD_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]


# --- extraction ------------------------------------------------------------------------


def _extracted(line: Callable[[], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = meaningful_lines(D.lines_of(spark, sf_dir, line()))
        return extract(lines).select(F.col("pos").alias("event_id"), *RECORD_COLUMNS)
    return query


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(meaningful_lines(D.mixed_lines(spark, sf_dir)))


def extract_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(mixed(spark, sf_dir)).select(F.col("pos").alias("event_id"), *RECORD_COLUMNS)


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_projection(parsed(mixed(spark, sf_dir)))


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(mixed(spark, sf_dir)).select(F.col("pos").alias("event_id"), "line")


# --- timestamps and fields -------------------------------------------------------------


def _timestamps(text: Callable[[], Column], **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = D.with_parts(D.events(spark, sf_dir)).select("event_id", text().alias("raw"))
        return with_timestamp(df, "raw", **options).select("event_id", "date", "time", "tz")
    return query


def _written_forms() -> Column:
    ts = F.col("ts")
    stamp = D.case(
        event_id() % 7, *[F.date_format(ts, f) for f in (
            "dd/MMM/yyyy:HH:mm:ss", "dd/MMM/yyyy HH:mm:ss", "MMM d yyyy 'at' HH:mm:ss", "MMM  d yyyy H:mm:ss",
            "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss")])
    zone = D.case(event_id() % 5, D.case(event_id() % 3, "Z", " UTC", "GMT"), " -0700", "+02:00", " +05:30", "")
    return F.concat(F.when(event_id() % 2 == 0, " [").otherwise(""), stamp, zone, F.when(event_id() % 2 == 0, "]").otherwise(""))


def _unreadable_forms() -> Column:
    number = event_id().cast("string")
    return D.case(
        event_id() % 6,
        F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +2500")),
        F.concat(F.lit("2024-02-30 10:00:"), F.lpad((event_id() % 60).cast("string"), 2, "0"), F.lit(" +0200")),
        F.concat(F.lit("whenever o'clock "), number),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:"), F.lit("60")),
        F.concat(F.lit("1700"), number),
        F.lit("Feb 29 12:00:00"))


def duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("string")
    text = D.case(event_id() % 4, F.concat(F.lit("took "), value, F.lit(" ms")), value, F.col("took"),
                  F.concat(value, F.lit(" sec")))
    df = D.with_parts(D.events(spark, sf_dir)).select("event_id", "value", "took", text.alias("text"))
    return df.select("event_id", X.duration_ms(F.col("text")).alias("duration_ms"))


def status_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    text = D.case(event_id() % 4, status, F.concat(F.lit(" "), status, F.lit(" ")), F.substring(status, 1, 2),
                  F.concat(status, F.lit(".0")))
    df = D.with_parts(D.events(spark, sf_dir)).select("event_id", text.alias("text"))
    return df.select("event_id", X.to_status(F.col("text")).alias("status"))


def request_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    method, url = F.col("method"), F.col("url")
    text = D.case(
        event_id() % 4, F.concat(method, F.lit(" "), url, F.lit(" HTTP/1.1")), F.concat(F.lit(" "), method, F.lit("  "), url),
        F.concat(F.lower(method), F.lit(" "), url), F.concat(method, F.lit(" "), url, F.lit(" a b")))
    df = D.with_parts(D.events(spark, sf_dir)).select("event_id", X.split_request(text).alias("parts"))
    hit = F.size("parts") == 2
    return df.select(
        "event_id", F.when(hit, F.get("parts", F.lit(0))).alias("method"),
        F.when(hit, F.get("parts", F.lit(1))).otherwise(F.get("parts", F.lit(0))).alias("url"))


def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.with_parts(D.events(spark, sf_dir))
    return df.select("event_id", X.status_class(X.to_status(F.col("status"))).alias("status_class"))


URL_SUFFIXES = (
    "", "/.env", "/%2egit/config", "/wp-login.php?x=1", "/admin/config", "/admin//config/a",
    "/docs/.environment-setup", "/blog/using.gitlab-ci", "/a%zz+b", "\\.ssh\\id", "#/.env", "?q=/.env",
    "/.ENV.production", "/credentials.bak", "/server-status/", "/adminconfig",
)


def _page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = D.case(F.col("page_id") % 16, *URL_SUFFIXES)
    pages = D.table(spark, sf_dir, "pages", "page_id", "url")
    return pages.select("page_id", F.concat("url", suffix).alias("url"))


def path_segment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = path_segments(F.col("url"))
    return _page_urls(spark, sf_dir).select(
        "page_id", F.array_join(segments, "|").alias("segments"))


def suspicious_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_urls(spark, sf_dir).select("page_id", is_suspicious(F.col("url")).alias("is_probe"))


# --- tallies and totals -------------------------------------------------------------------


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(D.mixed_lines(spark, sf_dir))


def _tally(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = A.tally_counts(_rows(spark, sf_dir), (name,))
        return A.top_keys(counts).select("key", "n", "rank")
    return query


def format_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.mixed_lines(spark, sf_dir).withColumn("file", F.concat(F.lit("log-"), (F.col("pos") % 3).cast("string")))
    return A.format_profile(extract(meaningful_lines(lines)))


def report_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the report, as a job makes it."""
    return report(_rows(spark, sf_dir))[0]


def report_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the report."""
    return report(_rows(spark, sf_dir))[1]


def summary_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_keys(A.tally_counts(_rows(spark, sf_dir)))


def traffic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scalars(A.tally_counts(_rows(spark, sf_dir))).where("parsed > 0")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.tally_counts(_rows(spark, sf_dir), (A.DURATION,))
    values = counts.select(F.col("key").cast("bigint").alias("value"), "n")
    return S.weighted_percentiles(values, {"p50_ms": 0.50, "p95_ms": 0.95})


#: What the estimated report states exactly.
EXACT_TOTALS = ("parsed", "skipped", "timed", "mean_ms", "rate_4xx", "rate_5xx", "probe_attempts", "probe_successes")


def approx_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact figures of the estimated report, and whether its percentiles are marked as estimates."""
    one = S.approx_scalars(_rows(spark, sf_dir)).where("parsed > 0")
    return one.select(*EXACT_TOTALS, "percentiles_exact")


def approx_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the estimated number of addresses lies within its stated bounds."""
    rows = _rows(spark, sf_dir)
    exact = S.scalars(A.tally_counts(rows, ("ip",))).select(F.col("unique_ips").alias("ips"))
    estimate = S.approx_scalars(rows).select("unique_ips_low", "unique_ips_high")
    both = exact.unionByName(estimate, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select(F.col("ips").between(F.col("unique_ips_low"), F.col("unique_ips_high")).alias("holds"))


def approx_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sketched report counts exactly."""
    return A.approx_top_keys(_rows(spark, sf_dir)).where("exact").select("tally", "key", "n", "rank")


def top_2000_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_keys(A.tally_counts(_rows(spark, sf_dir), ("url",)), 2000).select("key", "n", "rank")


def approx_top_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_rows(spark, sf_dir), JobOptions(exact=False))[0].where("tally = 'ip'")


# --- redaction --------------------------------------------------------------------------------


def _documents(mask: Callable[[Column], Column], suffix: Callable[[], Column] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = D.table(spark, sf_dir, "documents", "doc_id", "text")
        text = F.col("text") if suffix is None else F.concat(F.col("text"), suffix())
        return docs.select("doc_id", text.alias("text")).select("doc_id", mask(F.col("text")).alias("text"))
    return query


def redact_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.lower(F.hex(event_id() % 65536)), F.lower(F.hex(D.user_id() % 65536))
    a, b, c = (event_id() % 256).cast("string"), (D.user_id() % 256).cast("string"), (event_id() % 250).cast("string")
    text = D.case(
        event_id() % 6,
        F.concat(F.lit("from 2001:db8:"), high, F.lit("::"), low, F.lit(" ok")),
        F.concat(F.lit("[2001:DB8:"), high, F.lit(":1::"), low, F.lit("]:443")),
        F.concat(F.lit("fe80::"), low, F.lit("%eth0, 2001:0db8:0000:0000:0000:0000:0000:"), low),
        F.concat_ws(".", F.lit("::ffff:192"), a, b, c),
        F.concat(F.lit("::ffff:c0a8:"), F.lower(F.hex(F.lit(256) + event_id() % 60000))),
        F.concat(F.lit("at 13:55:"), F.lpad((event_id() % 60).cast("string"), 2, "0"), F.lit(" x")))
    df = D.events(spark, sf_dir).select("event_id", text.alias("text"))
    return df.select("event_id", R.mask_ipv6(F.col("text")).alias("text"))


def redact_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process(D.mixed_lines(spark, sf_dir), JobOptions(redact=R.anonymise))
    return rows.where("format is not null or line is not null").select(
        F.col("pos").alias("event_id"), "format", "ip", "url", "line")


def redacted_top_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process(D.mixed_lines(spark, sf_dir), JobOptions(redact=R.anonymise))
    return A.top_keys(A.tally_counts(rows, ("ip",))).select("key", "n", "rank")


# --- the flagship ---------------------------------------------------------------------------------


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every status class in an access log."""
    lines = D.lines_of(spark, sf_dir, D.combined_line())
    rows = with_probe_columns(parsed(extract(meaningful_lines(lines))))
    counts = A.tally_counts(rows, ("status_class",))        # ten rows at most
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100
    return counts.select(F.col("key").alias("status_class"), "n", share.alias("percent"))


REFERENCE = datetime(2024, 1, 15)

QUERIES: dict[str, Query] = {
    "error_rates": error_rates,
    "extract_combined": _extracted(D.combined_line),
    "extract_common": _extracted(D.common_line),
    "extract_fixed8": _extracted(D.fixed8_line),
    "extract_json": _extracted(D.json_line),
    "extract_generic": _extracted(D.generic_line),
    "extract_mixed": extract_mixed,
    "csv_rows": csv_rows,
    "rejected_lines": rejected_lines,
    "timestamps_utc": _timestamps(_written_forms),
    "timestamps_yearless": _timestamps(lambda: F.date_format("ts", "MMM d HH:mm:ss"), reference=REFERENCE),
    "timestamps_assumed": _timestamps(_written_forms, assume_tz="+02:00"),
    "timestamps_passthrough": _timestamps(_unreadable_forms, reference=REFERENCE),
    "duration_ms": duration_ms,
    "status_code": status_code,
    "request_split": request_split,
    "status_class": status_class,
    "path_segments": path_segment_lists,
    "suspicious_urls": suspicious_urls,
    "format_counts": _tally("format"),
    "status_counts": _tally("status_class"),
    "level_counts": _tally("level"),
    "top_ips": _tally("ip"),
    "top_urls": _tally("url"),
    "top_probe_ips": _tally("probe_ip"),
    "top_probe_paths": _tally("probe_path"),
    "probe_hits": _tally("probe_hit"),
    "broken_links": _tally("broken_link"),
    "format_profile": format_profile,
    "summary_tallies": summary_tallies,
    "report_tallies": report_tallies,
    "report_scalars": report_scalars,
    "traffic_totals": traffic_totals,
    "latency_percentiles": latency_percentiles,
    "approx_bounds": approx_bounds,
    "approx_tallies": approx_tallies,
    "top_2000_urls": top_2000_urls,
    "approx_totals": approx_totals,
    "approx_top_ips": approx_top_ips,
    "redact_secrets": _documents(R.mask_secrets),
    "redact_auth": _documents(R.mask_auth, lambda: F.concat(
        F.lit(" by Bearer abcdefgh"), F.col("doc_id").cast("string"))),
    "redact_email": _documents(R.mask_email),
    "redact_ipv4": _documents(R.mask_ipv4),
    "redact_ipv6": redact_ipv6,
    "redact_all_records": redact_all_records,
    "redacted_top_ips": redacted_top_ips,
}
