"""The exact report from a written table, without a shuffle of keys.

It reads the table a few times, by few columns, where the report of one pass shuffles
every distinct key once: candidates and their counts for the top keys, bitmaps for
distinct addresses, bucket counts for percentiles, sums for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.addresses import distinct_addresses
from logspark.operators.candidates import TRACKED, two_pass_top_keys
from logspark.operators.probes import probe_succeeded
from logspark.operators.refinement import refined_percentiles
from logspark.operators.scalars import PERCENTILES, SCALARS
from logspark.operators.tallies import is_rejected


def two_pass_scalars(rows: DataFrame) -> DataFrame:
    """The scalars of the report, one row, exact."""
    rate = lambda part: F.try_divide(part.cast("double"), F.count("status").cast("double")) * 100
    total = F.sum(F.col("duration_ms").cast("decimal(38,0)"))
    sums = rows.agg(
        F.count("format").alias("parsed"), F.count_if(is_rejected(rows)).alias("skipped"), F.count("duration_ms").alias("timed"),
        F.try_divide(total.cast("double"), F.count("duration_ms").cast("double")).alias("mean_ms"),
        rate(F.count_if(F.col("status_class") == "4xx")).alias("rate_4xx"),
        rate(F.count_if(F.col("status_class") == "5xx")).alias("rate_5xx"),
        F.count_if(F.col("is_probe")).alias("probe_attempts"), F.count_if(probe_succeeded()).alias("probe_successes"))
    found = refined_percentiles(rows.select(F.col("duration_ms").alias("value")), PERCENTILES)
    one = sums.unionByName(distinct_addresses(rows).select("unique_ips"), allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    return one.withColumns({
        **{name: F.lit(v).cast("bigint") for name, v in found.items()}, "percentiles_exact": F.lit(True)}).select(*SCALARS)


def two_pass_report(rows: DataFrame, k: int = 10, work: str | None = None, tracked: int = TRACKED) -> tuple[DataFrame, DataFrame]:
    """``(tallies, scalars)`` equal to those of the report of one pass."""
    tallies = two_pass_top_keys(rows, k, work, tracked).withColumn("exact", F.lit(True))
    one = two_pass_scalars(rows).withColumns({"unique_ips_low": F.col("unique_ips"), "unique_ips_high": F.col("unique_ips")})
    return tallies, one.where(F.col("parsed") > 0)
