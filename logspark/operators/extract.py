"""Lines to records: recognise, normalise, and split off what fits no layout."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.fixed_values import CSV_HEADERS
from logspark.functions import fields as X
from logspark.functions.text import strip
from logspark.functions.timestamps import with_timestamp
from logspark.operators.layouts import DEFAULT_LAYOUTS, Layout, with_raw_fields
from logspark.plans.once import computed_once
from logspark.schema import DERIVED_COLUMNS, RECORD_COLUMNS


def meaningful_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Strip every line, then drop blank ones and ``#`` comments."""
    text = F.col(line)
    return computed_once(df.withColumn(line, strip(text))).where((text != "") & ~text.startswith("#"))


def extract(
    df: DataFrame,
    line: str = "line",
    layouts: Sequence[Layout] = DEFAULT_LAYOUTS,
    assume_tz: str | None = None,
    reference_time: str | datetime | None = None,
    rejected_text_only: bool = False,
) -> DataFrame:
    """Add the record columns to a dataset of stripped lines.

    A line that fits no layout keeps NULL in all of them, ``format`` included;
    see :func:`parsed` and :func:`rejected`. The year of a date without one
    comes from ``reference_time``, a time or the name of a column, else from the
    column ``file_mtime`` if the lines have it, else from the clock. With
    ``rejected_text_only`` the line itself is kept only where nothing fits, which
    spares copying it through the steps that follow.
    """
    kept = df.columns
    if reference_time is None and "file_mtime" in kept:
        reference_time = "file_mtime"
    # Raw fields get names of their own, as the lines may have such columns already.
    inside = {c: f"_in_{i}" for i, c in enumerate(kept)}
    lines = df.select(*[df[f"`{c}`"].alias(i) for c, i in inside.items()])
    df = computed_once(with_raw_fields(lines, inside[line], layouts))
    if rejected_text_only:
        df = df.withColumn(inside[line], F.when(F.col("format").isNull(), F.col(inside[line])))
    df = df.withColumn("_request", X.split_request(F.col("request")))
    is_request = F.size("_request") == 2
    df = df.select(
        *inside.values(), "format", F.col("ts").alias("_ts"), F.upper("level").alias("level"), "ip",
        F.coalesce("method", F.when(is_request, F.get("_request", F.lit(0)))).alias("method"),
        F.coalesce("url", F.when(is_request, F.get("_request", F.lit(1))).otherwise(F.col("request"))).alias("url"),
        X.to_status(F.col("status")).alias("status"),
        X.to_milliseconds(F.col("duration"), F.col("unit")).alias("duration_ms"),
        "bytes", F.col("bytes").try_cast("bigint").alias("bytes_n"),
    )
    if isinstance(reference_time, str):
        reference_time = inside[reference_time]
    df = with_timestamp(df, "_ts", assume_tz, reference_time)
    df = df.select(*[F.col(i).alias(c) for c, i in inside.items()], *RECORD_COLUMNS, *DERIVED_COLUMNS)
    return computed_once(df)


def parsed(df: DataFrame) -> DataFrame:
    """The rows of :func:`extract` that are records."""
    return df.where(F.col("format").isNotNull())


def rejected(df: DataFrame) -> DataFrame:
    """The rows of :func:`extract` that fit no layout."""
    return df.where(F.col("format").isNull())


def csv_projection(df: DataFrame) -> DataFrame:
    """The eleven record columns in their fixed order under their CSV names."""
    return df.select(*[F.col(c).alias(h) for c, h in zip(RECORD_COLUMNS, CSV_HEADERS)])
