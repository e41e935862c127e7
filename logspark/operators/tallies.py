"""Tallies: counts per key, all of them in one grouping.

Every record contributes an entry to each tally it belongs to. The entries are
counted in a single aggregation, which combines on the map side, so a key that
holds a third of all rows arrives at the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.urls import describe_hit
from logspark.operators.probes import is_broken_link, probe_succeeded
from logspark.plans.once import computed_once

#: In the order a report shows them.
TALLIES = (
    "probe_hit", "format", "status_class", "level", "ip",
    "probe_ip", "probe_path", "broken_link", "url",
)
#: Listed in full: the number of keys is bounded by the layouts and by ten classes.
LISTED_IN_FULL = ("format", "status_class")
#: Counted exactly even where the others are sketched: their keys are few.
FEW_KEYS = (*LISTED_IN_FULL, "level")
#: Parts in which the keys of a tally are ranked before the tally is.
RANK_PARTS = 64
#: Items that a sketch may track at most, by Spark.
MOST_TRACKED = 1_000_000
#: Entries the scalars are computed from; not tallies of their own.
DURATION, REJECTED = "duration_ms", "rejected"


def is_rejected(df: DataFrame) -> Column:
    """Rows that had text and fit no layout; blanks and comments, whose line is NULL, are neither."""
    unread = F.col("format").isNull()
    return unread & F.col("line").isNotNull() if "line" in df.columns else unread


def _keys(df: DataFrame) -> dict[str, Column]:
    """The key a record counts under in each tally, NULL where it does not count."""
    probe, url = F.col("is_probe"), F.col("url")
    return {
        "format": F.col("format"),
        "status_class": F.col("status_class"),
        "level": F.col("level"),
        "ip": F.col("ip"),
        "url": url,
        "probe_ip": F.when(probe, F.coalesce("ip", F.lit("unknown"))),
        "probe_path": F.when(probe, url),
        "probe_hit": F.when(probe_succeeded(), describe_hit(F.col("status"), F.col("method"), url, F.col("ip"))),
        # An empty URL is a broken link too.
        "broken_link": F.when(is_broken_link(), F.coalesce(url, F.lit(""))),
        DURATION: F.col("duration_ms").cast("string"),
        REJECTED: F.when(is_rejected(df), F.lit("")),
    }


def tally_entries(df: DataFrame, tallies: tuple[str, ...] | None = None, pos: str = "pos") -> DataFrame:
    """``(tally, key, pos)``, one row per record and tally it counts in.

    ``df`` has record and probe columns; rows without a format are rejected lines,
    unless their ``line`` is NULL: blanks and comments count nowhere.
    """
    keys = _keys(df)
    entries = F.array(*[
        F.struct(F.lit(name).alias("tally"), keys[name].alias("key"))
        for name in (tallies or tuple(keys))
    ])
    return (
        df.select(F.col(pos).alias("pos"), F.explode(entries).alias("entry"))
        .select("entry.tally", "entry.key", "pos")
        .where(F.col("key").isNotNull())
    )


def tally_counts(df: DataFrame, tallies: tuple[str, ...] | None = None, pos: str = "pos") -> DataFrame:
    """``(tally, key, n, first_seen)``: one shuffle for everything in a report."""
    return (
        tally_entries(df, tallies, pos).groupBy("tally", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_seen"))
    )


def top_keys(counts: DataFrame, k: int = 10, landed: bool = False) -> DataFrame:
    """``(tally, key, n, rank)``: the ``k`` largest per tally, first seen first.

    Formats and status classes are listed in full, classes in their own order.
    Keys are ranked in parts of a tally first and the ``k`` best of every part
    then in the tally, so no task sees all keys of one, however large ``k``.
    ``landed`` counts are a written table, whose scan takes the filters.
    """
    if not landed:
        # The two filters must not change the counting below them: both branches
        # then read one shuffle.
        counts = computed_once(counts)
    by_size = (F.desc("n"), "first_seen", "key")
    in_part = Window.partitionBy("tally", "part").orderBy(*by_size)
    order = Window.partitionBy("tally").orderBy(*by_size)
    top = (
        counts.where(~F.col("tally").isin(*LISTED_IN_FULL, DURATION, REJECTED))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RANK_PARTS)))
        .withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    )
    by_class = F.when(F.col("tally") == "status_class", F.col("key"))
    listed = Window.partitionBy("tally").orderBy(by_class, F.desc("n"), "first_seen")
    full = counts.where(F.col("tally").isin(*LISTED_IN_FULL)).withColumn("rank", F.row_number().over(listed))
    return top.select("tally", "key", "n", "rank").unionByName(full.select("tally", "key", "n", "rank")).select(
        "tally", "key", "n", F.col("rank").cast("int").alias("rank"))


def format_profile(df: DataFrame) -> DataFrame:
    """Rows per file and format: shows files that mix layouts or were misread."""
    return df.where(F.col("format").isNotNull()).groupBy("file", "format").agg(F.count(F.lit(1)).alias("n"))


def approx_top_keys(df: DataFrame, k: int = 10, tracked: int | None = None) -> DataFrame:
    """:func:`top_keys` with a column ``exact``: the tallies of many keys come from bounded sketches.

    Those need no shuffle of keys and their counts are estimates; formats, status
    classes and levels are counted. A sketch tracks 100 times ``k`` items unless told.
    """
    tracked = tracked or max(10_000, min(100 * k, MOST_TRACKED))
    many = tuple(t for t in TALLIES if t not in FEW_KEYS)
    sketched = tally_entries(df.withColumn("_pos", F.lit(0)), many, "_pos").groupBy("tally").agg(
        F.expr(f"approx_top_k(key, {int(k)}, {int(tracked)})").alias("top"))
    estimates = sketched.select("tally", F.posexplode("top").alias("at", "hit")).select(
        "tally", F.col("hit.item").alias("key"), F.col("hit.count").alias("n"),
        (F.col("at") + 1).cast("int").alias("rank"), F.lit(False).alias("exact"))
    return top_keys(tally_counts(df, FEW_KEYS), k).withColumn("exact", F.lit(True)).unionByName(estimates)
