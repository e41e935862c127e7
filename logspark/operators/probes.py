"""Scanner probes, successful ones, and broken links."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.fixed_values import PROBE_SUCCESS_MAX
from logspark.functions.fields import status_class
from logspark.functions.urls import is_suspicious
from logspark.plans.once import computed_once


def with_probe_columns(df: DataFrame) -> DataFrame:
    """Add ``is_probe`` and ``status_class``. Apply redaction first, if any."""
    return computed_once(df.withColumns({
        "is_probe": is_suspicious(F.col("url")),
        "status_class": status_class(F.col("status")),
    }))


def probe_succeeded() -> Column:
    """The probe was served rather than refused; a redirect counts as served."""
    return F.col("is_probe") & F.coalesce(F.col("status") < PROBE_SUCCESS_MAX, F.lit(False))


def is_broken_link() -> Column:
    """A 4xx answer to an ordinary request."""
    return F.coalesce(F.col("status").between(400, 499), F.lit(False)) & ~F.col("is_probe")
