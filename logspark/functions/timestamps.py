"""Timestamp normalisation: many written forms to one UTC date and time.

The work is staged over projections, so each regex runs once per row.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import fixed_values as V
from logspark.functions.text import exprs, number_groups, replaced_parts, strip, unicode_space

_SEP = "\x01"
_ZONE = rf"(?:{V.UTC_OFFSET}|{V.ZONE_NAME})"
_ZONE_TAIL = rf"(?s)^(.*?)\s*({_ZONE})\z"
_SUBSECOND = unicode_space(V.SUBSECOND)


def _layouts() -> tuple[str, dict[str, list[str]]]:
    """All written forms as one alternation, and the group names of each part."""
    # {Y} {B} {M} {D} {T} are year, month name, month number, day and time of day.
    forms = (
        r"{D}/{B}/{Y}(?:(?::|\s+){T})?",
        r"{B}\s+{D}\s+{Y}\s+(?:at\s+)?{T}",
        r"{Y}-{M}-{D}(?:(?:\s+|T){T})?",
        r"{Y}/{M}/{D}\s+{T}",
        r"{B}\s+{D}\s+{T}",
    )
    parts = {
        "Y": r"(?!0000)\d{4}",
        "B": "|".join(V.MONTHS),
        "M": r"1[0-2]|0[1-9]|[1-9]",
        "D": r"3[01]|[12]\d|0[1-9]|[1-9]| [1-9]",
        "T": r"(?:2[0-3]|[01]\d|\d):(?:[0-5]\d|\d):(?:[0-5]\d|\d)",
    }
    groups: dict[str, list[str]] = {key: [] for key in parts}
    compiled = []
    for i, form in enumerate(forms):
        for key, body in parts.items():
            if "{" + key + "}" in form:
                groups[key].append(f"{key}{i}")
                form = form.replace("{" + key + "}", f"(?<{key}{i}>{body})")
        compiled.append(form)
    return "(?i:" + "|".join(compiled) + ")", groups


def _with_parts(pattern: str) -> tuple[str, str]:
    """A pattern around the layouts, and the replacement that lists the parts."""
    number = number_groups(pattern)
    listed = ["".join(f"${number[name]}" for name in names) for names in _GROUPS.values()]
    zone = f"${number['Z']}" if "Z" in number else ""
    return pattern, _SEP.join([*listed, zone])


_LAYOUT, _GROUPS = _layouts()
# A whole timestamp in its usual spelling: everything is read in one match.
_USUAL = _with_parts(
    rf"^\s*+[\[\]]*+(?:{_LAYOUT})(?:[.,]\d+)?(?:\s*(?<Z>{_ZONE}))?[\[\]]*+\s*+\z")
# What is left of an unusual one after zone and sub-seconds are cut out.
_BARE = _with_parts(rf"^(?:{_LAYOUT})\z")


def normalise_offset(text: Column) -> Column:
    """Any accepted zone spelling as ``+HHMM``; NULL if it is not one."""
    bare = strip(text)
    return (
        F.when(bare.rlike(rf"(?i)^(?:{V.ZONE_NAME})\z"), F.lit("+0000"))
        .when(bare.rlike(rf"^(?:{V.UTC_OFFSET})\z"), F.replace(bare, F.lit(":"), F.lit("")))
    )


def checked_offset(text: str) -> str:
    """The same for an option: ``+HHMM``, or ``ValueError`` before any job starts."""
    bare = text.strip()
    if re.fullmatch(V.ZONE_NAME, bare.upper()):
        return "+0000"
    if re.fullmatch(V.UTC_OFFSET, bare):
        return bare.replace(":", "")
    raise ValueError(
        f"{text!r} is not a usable offset: use +HHMM, +HH:MM or Z, within -1200 to +1400"
    )


def _written(df: DataFrame, parts: str, out: str) -> DataFrame:
    """Add the time the parts stand for, as written; NULL if there is no such time."""
    kept = df.columns
    # Parts: year, month name, month number, day, time of day, zone.
    month = f"coalesce({parts}[2], (instr('{''.join(V.MONTHS)}', lower({parts}[1])) + 2) div 3)"
    rest = f"concat('-', {month}, '-', ltrim({parts}[3]), ' ', coalesce({parts}[4], '0:0:0'))"
    df = df.select(*kept, *exprs(
        f"if(size({parts}) = 6, {parts}[0], null) as _year", f"if(size({parts}) = 6, {rest}, null) as _rest"))
    # A date without a year is this year's, or last year's if that would put it
    # more than a day ahead. 29 February has no year to be checked against.
    this_year = "try_cast(concat(year(_now), _rest) as timestamp_ntz)"
    last_year = "try_cast(concat(year(_now) - 1, _rest) as timestamp_ntz)"
    return df.select(*kept, *exprs(
        "case when _year is not null then try_cast(concat(_year, _rest) as timestamp_ntz)"
        f" when not _rest rlike '^-0?2-29 ' then"
        f" if({this_year} > _now + interval 1 day, {last_year}, {this_year}) end as {out}"))


def with_timestamp(
    df: DataFrame,
    raw: str,
    assume_tz: str | None = None,
    reference: str | datetime | None = None,
) -> DataFrame:
    """Add ``date``, ``time``, ``tz`` and ``event_ts`` for the text column ``raw``.

    A time with an offset is moved to UTC and keeps the offset in ``tz``. One
    without is left as written unless ``assume_tz`` names the writer's clock.
    ``reference``, a time or the name of a column, supplies the year where the
    text has none. Text in no known layout is passed through, split at its
    first space, with NULL ``event_ts``.
    """
    assumed = checked_offset(assume_tz) if assume_tz else None
    if reference is None:
        reference = F.localtimestamp()
    elif isinstance(reference, datetime):
        reference = F.lit(reference.isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        reference = F.col(reference).cast("timestamp_ntz")
    kept = df.columns

    df = df.select(*kept, reference.alias("_now"), replaced_parts(F.col(raw), *_USUAL, _SEP).alias("_usual"))
    df = _written(df, "_usual", "_at")

    # Texts not read so far: cut zone and sub-seconds off and try what is left.
    bare = F.btrim(strip(F.col(raw)), F.lit("[]"))
    df = df.withColumn("_cut", F.when(
        F.col("_at").isNull(), replaced_parts(bare, _ZONE_TAIL, f"$1{_SEP}$2", _SEP)))
    cut, cut_zone = F.get("_cut", F.lit(0)), F.get("_cut", F.lit(1))
    df = df.withColumns({
        "_text": F.regexp_replace(F.when(cut_zone.isNull(), cut).otherwise(strip(cut)), _SUBSECOND, ""),
        "_zone": F.when(F.col("_at").isNull(), cut_zone).otherwise(F.get("_usual", F.lit(5))),
    })
    df = df.withColumn("_again", F.when(
        F.size("_usual") < 6, replaced_parts(F.col("_text"), *_BARE, _SEP)))
    df = _written(df, "_again", "_at_last")

    zone = f"coalesce(_zone, '{assumed}')" if assumed else "_zone"
    df = df.select(*kept, *exprs(
        "_text", "coalesce(_at, _at_last) as _at",
        "if(length(_zone) < 4, '+0000', replace(_zone, ':', '')) as _zone"))
    df = df.select(*kept, *exprs(
        "_text", "_at", f"if(_at is not null, {zone}, _zone) as tz", f"{zone} as _zone"))
    minutes = "(int(substr(_zone, 2, 2)) * 60 + int(substr(_zone, 4, 2))) * int(concat(left(_zone, 1), '1'))"
    df = df.select(*kept, *exprs(
        "_text", "tz",
        f"if(_zone is null or _zone = '+0000', _at, _at - interval '1' minute * {minutes}) as event_ts"))
    # A time that could not be read is passed on as text, cut at the first space.
    clock = ", ".join(f"lpad({part}(event_ts), 2, '0')" for part in ("hour", "minute", "second"))
    return df.select(*kept, *exprs(
        "coalesce(string(date(event_ts)), nullif(substring_index(_text, ' ', 1), '')) as date",
        f"if(event_ts is not null, concat_ws(':', {clock}),"
        " if(instr(_text, ' ') > 0, nullif(substring(_text, instr(_text, ' ') + 1), ''), null)) as time",
        "tz", "event_ts",
    ))
