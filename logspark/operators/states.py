"""Report states: sketches kept as binary columns, merged over days, files or runs.

One row a group holds sums and the states of a distinct count and of percentiles; one
row a group and tally the state of its most frequent keys. States are written like any
table. Figures of any union of groups come from merging their states, without reading a
line again, and each estimate has its bound beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.candidates import MANY_KEYS, TRACKED, sketch_error
from logspark.operators.probes import probe_succeeded
from logspark.operators.scalars import PERCENTILES
from logspark.operators.tallies import is_rejected, tally_entries

#: Log2 of the registers of a distinct-count sketch, and the k of a percentile sketch.
LG_K, KLL_K = 14, 800
#: Bounds are so many standard errors wide.
DEVIATIONS = 4
SUMS = (
    "parsed", "skipped", "timed", "duration_sum", "with_status", "n_4xx", "n_5xx", "probe_attempts", "probe_successes",
)


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged distinct-count sketch."""
    return 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = KLL_K) -> float:
    """By which share of the rows the rank of an estimated percentile is off, with 99 % confidence."""
    return 2.296 / k**0.9723


def totals_state(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, sums, ips, durations)``: one row a group, from processed rows with the columns ``by``."""
    return rows.groupBy(*by).agg(
        F.count("format").alias("parsed"),
        F.count_if(is_rejected(rows)).alias("skipped"),
        F.count("duration_ms").alias("timed"),
        F.coalesce(F.sum(F.col("duration_ms").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("duration_sum"),
        F.count("status").alias("with_status"),
        F.count_if(F.col("status_class") == "4xx").alias("n_4xx"),
        F.count_if(F.col("status_class") == "5xx").alias("n_5xx"),
        F.count_if(F.col("is_probe")).alias("probe_attempts"),
        F.count_if(probe_succeeded()).alias("probe_successes"),
        F.hll_sketch_agg("ip", F.lit(LG_K)).alias("ips"),
        F.kll_sketch_agg_bigint("duration_ms", F.lit(KLL_K)).alias("durations"),
    )


def merge_totals(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The states of the unions of groups that agree in ``by``."""
    return states.groupBy(*by).agg(
        *[F.sum(c).cast("decimal(38,0)" if c == "duration_sum" else "long").alias(c) for c in SUMS],
        F.hll_union_agg("ips").alias("ips"), F.kll_merge_agg_bigint("durations", F.lit(KLL_K)).alias("durations"))


def read_totals(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Figures of every state; ``rank_error`` is that of the percentiles, the rest is exact or bounded."""
    ips = F.hll_sketch_estimate("ips")
    off = DEVIATIONS * distinct_error()
    share = lambda part: F.try_divide(F.col(part).cast("double"), F.col("with_status").cast("double")) * 100

    def at(fraction: float) -> Column:
        return F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("durations", F.lit(fraction)))

    return states.select(
        *by, "parsed", "skipped", ips.alias("unique_ips"), F.floor(ips * (1 - off)).alias("unique_ips_low"),
        F.ceil(ips * (1 + off)).alias("unique_ips_high"), "timed",
        F.try_divide(F.col("duration_sum").cast("double"), F.col("timed").cast("double")).alias("mean_ms"),
        *[at(f).alias(name) for name, f in PERCENTILES.items()], F.lit(2 * rank_error()).alias("rank_error"),
        share("n_4xx").alias("rate_4xx"), share("n_5xx").alias("rate_5xx"), "probe_attempts", "probe_successes")


def top_state(rows: DataFrame, by: tuple[str, ...], tracked: int = TRACKED, tallies: tuple[str, ...] = MANY_KEYS) -> DataFrame:
    """``(*by, tally, total, top)``: the most frequent keys of every group and tally, as states."""
    entries = tally_entries(rows.withColumn("_by", F.struct(*by)), tallies, "_by")
    grouped = entries.select("tally", "key", "pos.*").groupBy(*by, "tally")
    return grouped.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k_accumulate(key, {int(tracked)})").alias("top"))


def merge_top(states: DataFrame, by: tuple[str, ...] = (), tracked: int = TRACKED) -> DataFrame:
    """The states of the unions of groups that agree in ``by``, per tally."""
    return states.groupBy(*by, "tally").agg(
        F.sum("total").alias("total"), F.expr(f"approx_top_k_combine(top, {int(tracked)})").alias("top"))


def read_top(states: DataFrame, by: tuple[str, ...] = (), k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """``(*by, tally, key, n, error, rank)``: ``n`` is off by ``error`` at most; keys that occur at most twice that often may be missing."""
    hits = states.select(*by, "tally", sketch_error(F.col("total"), tracked).alias("error"),
                         F.posexplode(F.expr(f"approx_top_k_estimate(top, {int(k)})")).alias("at", "hit"))
    return hits.select(*by, "tally", F.col("hit.item").alias("key"), F.col("hit.count").alias("n"), "error",
                       (F.col("at") + 1).cast("int").alias("rank"))
