"""URL paths and the requests only a scanner would make."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark import fixed_values as V

_MARKERS = "|".join(re.escape(marker) for marker in V.SUSPICIOUS_SEGMENTS)
_SEQUENCES = "|".join("/+".join(map(re.escape, names)) for names in V.SUSPICIOUS_SEQUENCES)
# A whole segment, or one that a marker and a dot begin; or a run of segments.
_PROBE = rf"/(?:(?:{_MARKERS})(?:\.[^/]*)?|{_SEQUENCES})/"


def normalised_path(url: Column) -> Column:
    """The path in lower case: no query or fragment, percent signs decoded once,
    backslashes folded to slashes."""
    path = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    # A plus is not a blank in a path, and a stray percent sign stays as it is.
    escaped = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(F.contains(path, F.lit("%")), F.try_url_decode(escaped)).otherwise(path)
    return F.lower(F.translate(decoded, "\\", "/"))


def path_segments(url: Column) -> Column:
    """The path's non-empty segments; an empty array for a missing URL."""
    segments = F.split(normalised_path(F.coalesce(url, F.lit(""))), "/", -1)
    return F.filter(segments, lambda s: s != "")


def is_suspicious(url: Column) -> Column:
    """True for a path that only a scanner would ask for, never NULL.

    Works on the joined path, which gives the same answer as its segments: an
    empty segment counts for nothing, so one between two markers may be any
    number of slashes.
    """
    path = F.concat(F.lit("/"), normalised_path(url), F.lit("/"))
    return F.coalesce(path.rlike(_PROBE), F.lit(False))


def describe_hit(status: Column, method: Column, url: Column, ip: Column) -> Column:
    """``STATUS METHOD URL from IP`` for a request that was served."""
    return F.concat(
        status.cast("string"), F.lit(" "), F.coalesce(method, F.lit("?")), F.lit(" "), F.coalesce(url, F.lit("")),
        F.lit(" from "), F.coalesce(ip, F.lit("unknown")))
