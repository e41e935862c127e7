"""Column lists of the datasets the engine produces."""

from logspark.fixed_values import CSV_COLUMNS

RECORD_COLUMNS = CSV_COLUMNS
DERIVED_COLUMNS = ("event_ts", "bytes_n")

# What a layout takes from a line before any value is normalised.
RAW_FIELDS = (
    "format", "ts", "level", "ip", "method", "url", "request",
    "status", "duration", "unit", "bytes",
)
