"""Column functions for single fields: status, duration, request, JSON values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark import fixed_values as V
from logspark.functions.text import present, strip, unicode_space, word_edges

_REQUEST = unicode_space(V.REQUEST)
_DURATION = word_edges(V.MESSAGE_DURATION)
_FLOAT = unicode_space(V.FLOAT_TEXT)
_STATUS = unicode_space(r"^\s*([0-9]{3})\s*\z")


def to_status(text: Column) -> Column:
    """A three-digit status code as an integer, NULL for anything else."""
    return F.regexp_extract(text, _STATUS, 1).try_cast("int")


def float_text(text: Column) -> Column:
    """The text of a floating-point number as a cast reads it; NULL for other text."""
    return F.when(text.rlike(_FLOAT), F.replace(strip(text), F.lit("_"), F.lit("")))


def to_milliseconds(number: Column, unit: Column) -> Column:
    """Whole milliseconds, ties to even. ``number`` is text, ``unit`` may be ``s``."""
    value = number.try_cast("double")
    return F.rint(F.when(unit == "s", value * F.lit(1000.0)).otherwise(value)).try_cast("bigint")


def find_duration(text: Column) -> tuple[Column, Column]:
    """Number and unit of the first duration in free text."""
    return present(F.regexp_extract(text, _DURATION, 1)), present(F.regexp_extract(text, _DURATION, 2))


def duration_ms(text: Column) -> Column:
    """A duration field: a bare number is milliseconds, else the first one with a unit."""
    number, unit = find_duration(text)
    return to_milliseconds(F.coalesce(number, float_text(text)), unit)


def split_request(text: Column) -> Column:
    """Split ``GET /path HTTP/1.1`` into an array ``[method, url]``.

    The array has a single element, the text as given, if it is no request line.
    The separator is white space, so it cannot be part of a request line.
    """
    parts = F.split(F.regexp_replace(text, _REQUEST, "$1\n$2"), "\n", -1)
    # Text of its own may hold the separator.
    return F.when(text.contains("\n") & ~text.rlike(_REQUEST), F.array(text)).otherwise(parts)


def status_class(status: Column) -> Column:
    """``2xx``, ``4xx`` and so on."""
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
