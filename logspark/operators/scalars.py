"""The one-row half of a report: totals, rates, mean and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.probes import probe_succeeded
from logspark.operators.tallies import DURATION, REJECTED, is_rejected
from logspark.plans.once import computed_once


def weighted_percentiles(values: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of ``(value, n)`` rows, as one row.

    A single sorted pass would need all distinct values in one task. Instead
    they are cut into logarithmic buckets, at most about 44,000 on either side
    of zero whatever the values, so that running totals over the buckets are
    small; the rank is then looked up inside the one bucket that holds it.
    """
    v = F.col("value")
    bucket = (F.signum(v) * F.floor(F.log1p(F.abs(v.cast("double"))) * 1000)).cast("int")
    values = values.select("value", "n", bucket.alias("bucket"))
    in_bucket = values.withColumn("upto", F.sum("n").over(Window.partitionBy("bucket").orderBy("value")))
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        values.groupBy("bucket").agg(F.sum("n").alias("in_all"))
        .select(
            "bucket",
            F.coalesce(F.sum("in_all").over(below), F.lit(0)).alias("before"),
            F.sum("in_all").over(Window.partitionBy()).alias("total"))
    )
    located = in_bucket.join(F.broadcast(buckets), "bucket")
    last = F.col("before") + F.col("upto")

    def at(fraction: float) -> Column:
        rank = F.greatest(F.ceil(F.lit(fraction) * F.col("total")), F.lit(1))
        return F.max(F.when((last - F.col("n") < rank) & (rank <= last), v))

    return located.agg(*[at(fraction).alias(name) for name, fraction in fractions.items()])


PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95}
SCALARS = (
    "parsed", "skipped", "unique_ips", "timed", "mean_ms", "p50_ms", "p95_ms", "percentiles_exact",
    "rate_4xx", "rate_5xx", "probe_attempts", "probe_successes",
)


def _rate(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double")) * 100


#: Entries that totals are made of.
_SUMMED = ("format", REJECTED, "ip", DURATION, "status_class", "probe_ip", "probe_hit")


def scalars(counts: DataFrame, landed: bool = False) -> DataFrame:
    """Every figure of the report from the counts of all entries, in one row.

    ``landed`` counts are a written table, of which only the entries needed are read.
    """
    counts = counts.select("tally", "key", "n")
    # The percentiles' filter must not change the counting below it: then both
    # uses of the counts share one shuffle.
    counts = counts if landed else computed_once(counts)

    def rows(tally: str, key: str | None = None) -> Column:
        hit = F.col("tally") == tally
        hit = hit if key is None else hit & (F.col("key") == key)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    is_duration = F.col("tally") == DURATION
    value = F.when(is_duration, F.col("key").try_cast("bigint"))
    # A sum of 64-bit products can overflow on a single absurd value.
    total = F.sum(value.cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    totals = counts.where(F.col("tally").isin(*_SUMMED)).agg(
        rows("format").alias("parsed"),
        rows(REJECTED).alias("skipped"),
        F.count_if(F.col("tally") == "ip").alias("unique_ips"),
        rows(DURATION).alias("timed"),
        total.alias("duration_sum"),
        rows("status_class").alias("with_status"),
        rows("status_class", "4xx").alias("n_4xx"),
        rows("status_class", "5xx").alias("n_5xx"),
        rows("probe_ip").alias("probe_attempts"),
        rows("probe_hit").alias("probe_successes"),
    )
    percentiles = weighted_percentiles(
        counts.where(is_duration).select(F.col("key").try_cast("bigint").alias("value"), "n"), PERCENTILES)
    # Both are single rows; stacking them and taking the maximum merges them.
    one = totals.unionByName(percentiles, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    return one.select(
        "parsed", "skipped", "unique_ips", "timed",
        F.try_divide(F.col("duration_sum").cast("double"), F.col("timed").cast("double")).alias("mean_ms"),
        "p50_ms", "p95_ms", F.lit(True).alias("percentiles_exact"),
        _rate(F.col("n_4xx"), F.col("with_status")).alias("rate_4xx"),
        _rate(F.col("n_5xx"), F.col("with_status")).alias("rate_5xx"),
        "probe_attempts", "probe_successes",
    )


def approx_scalars(df: DataFrame, rsd: float = 0.02, accuracy: int = 10000) -> DataFrame:
    """The same figures in one pass without any shuffle of keys.

    Distinct addresses are estimated with the relative standard deviation
    ``rsd``; ``unique_ips_low`` and ``unique_ips_high`` are three of it away.
    Percentiles have a rank error of ``1 / accuracy``; the rest is exact.
    ``percentiles_exact`` says so.
    """
    has_status = F.count("status")
    fractions = F.array(*[F.lit(f) for f in PERCENTILES.values()])
    one = df.agg(
        F.count("format").alias("parsed"),
        F.count_if(is_rejected(df)).alias("skipped"),
        F.approx_count_distinct("ip", rsd).alias("unique_ips"),
        F.count("duration_ms").alias("timed"),
        F.avg("duration_ms").alias("mean_ms"),
        F.percentile_approx("duration_ms", fractions, accuracy).alias("_p"),
        _rate(F.count_if(F.col("status_class") == "4xx"), has_status).alias("rate_4xx"),
        _rate(F.count_if(F.col("status_class") == "5xx"), has_status).alias("rate_5xx"),
        F.count_if(F.col("is_probe")).alias("probe_attempts"),
        F.count_if(probe_succeeded()).alias("probe_successes"),
    )
    one = one.withColumns({name: F.get("_p", F.lit(i)) for i, name in enumerate(PERCENTILES)})
    bounds = {"unique_ips_low": F.floor(F.col("unique_ips") * (1 - 3 * rsd)),
              "unique_ips_high": F.ceil(F.col("unique_ips") * (1 + 3 * rsd))}
    return one.withColumn("percentiles_exact", F.lit(False)).withColumns(bounds).select(*SCALARS, *bounds)
