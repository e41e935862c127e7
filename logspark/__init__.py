"""Web and application logs as Spark DataFrames."""

from logspark.functions.redact import anonymise, keep
from logspark.operators.extract import extract, meaningful_lines, parsed, rejected
from logspark.operators.layouts import (
    COMMON, DEFAULT_LAYOUTS, FIXED8, GENERIC, JSON, ColumnLayout, JsonLayout, RegexLayout, raw_struct,
)
from logspark.plans.job import JobOptions, JobResult, process, report, run_job
from logspark.sources.text_logs import read_lines, with_line_numbers

__all__ = [
    "COMMON", "DEFAULT_LAYOUTS", "FIXED8", "GENERIC", "JSON", "ColumnLayout", "JobOptions", "JobResult",
    "JsonLayout", "RegexLayout", "anonymise", "extract", "keep", "meaningful_lines", "parsed", "process",
    "raw_struct", "read_lines", "rejected", "report", "run_job", "with_line_numbers",
]
