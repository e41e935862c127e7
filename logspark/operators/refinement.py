"""Exact percentiles by refinement: where a rank lies, narrowed down count by count.

Values are first counted in logarithmic buckets, then only those of the buckets that
hold a rank in equal cells, then those of that cell, until a cell is a single value.
A round exchanges one number a task and cell, never the distinct values, and the
number of rounds depends on the width of a bucket alone: two up to four million, six
for any 64-bit values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells a range is cut into; it bounds what a round exchanges and collects for a fraction.
CELLS = 4096


def log_bucket(value: Column) -> Column:
    """At most about 44,000 buckets on either side of zero, each 0.1 % wide."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value.cast("double"))) * 1000)).cast("int")


def _first_ranges(values: DataFrame, n: Column, fractions: dict[str, float]) -> dict[str, tuple[int, int, int, int]]:
    """For every fraction (rank, rows below, lowest, highest value) of the bucket that holds its rank."""
    buckets = values.groupBy(log_bucket(F.col("value")).alias("bucket")).agg(
        F.sum(n).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = buckets.select(
        "lo", "hi", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranks = {name: F.greatest(F.ceil(F.lit(f) * F.col("total")), F.lit(1)) for name, f in fractions.items()}
    holds = [(F.col("upto") - F.col("n") < r) & (r <= F.col("upto")) for r in ranks.values()]
    found = placed.where(F.array_contains(F.array(*holds), True)).collect()
    out = {}
    for name, f in fractions.items():
        for r in found:
            rank = max(math.ceil(f * r.total), 1)
            if r.upto - r.n < rank <= r.upto:
                out[name] = (rank, r.upto - r.n, r.lo, r.hi)
    return out


def refined_percentiles(values: DataFrame, fractions: dict[str, float], cells: int = CELLS) -> dict[str, int | None]:
    """Exact nearest-rank percentiles of 64-bit ``value`` rows, ``n`` of each where there is such a column.

    ``values`` are read once a round, so pass a written table. NULLs do not count;
    without any value the percentiles are None.
    """
    values = values.where(F.col("value").isNotNull())
    n = F.col("n") if "n" in values.columns else F.lit(1).cast("long")
    ranges = _first_ranges(values, n, fractions)
    while spans := sorted({(lo, hi) for _, _, lo, hi in ranges.values() if lo < hi}):
        value, inside = F.col("value"), []
        for i, (lo, hi) in enumerate(spans):
            width = -(-(hi - lo + 1) // cells)
            cell = F.floor((value - F.lit(lo)) / F.lit(width)).cast("int")  # in doubles: rounded, but in order
            inside.append(F.when(value.between(lo, hi), F.struct(F.lit(i).alias("span"), cell.alias("cell"))))
        counts = values.select("value", n.alias("n"), F.explode(F.array_compact(F.array(*inside))).alias("in")).groupBy("in").agg(
            F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        for name, (rank, below, lo, hi) in ranges.items():
            if lo < hi:
                span = spans.index((lo, hi))
                for r in sorted((r for r in counts if r["in"].span == span), key=lambda r: r["in"].cell):
                    if below + r.n >= rank:
                        ranges[name] = (rank, below, r.lo, r.hi)
                        break
                    below += r.n
    return {name: ranges[name][2] if name in ranges else None for name in fractions}
