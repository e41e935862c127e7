"""Line layouts: how to recognise a line and which raw fields it holds.

Three kinds exist. ``RegexLayout`` is a pattern with named groups; neighbouring
ones are merged into one alternation, so a line is matched once however many
layouts are tried. ``JsonLayout`` reads one JSON object per line.
``ColumnLayout`` wraps any ``Column -> Column`` of a caller.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import fixed_values as V
from logspark.functions import fields as X
from logspark.functions.text import bind, exprs, number_groups, present, replaced_parts, word_edges
from logspark.schema import RAW_FIELDS

_GROUPS = (
    "clock", "level", "ip", "method", "url", "request",
    "status", "duration", "unit", "bytes", "message", "pair",
)


def raw_struct(**values: Column) -> Column:
    """A struct of raw fields, NULL for those not given."""
    unknown = set(values) - set(RAW_FIELDS)
    if unknown:
        raise ValueError(f"not raw fields: {sorted(unknown)}")
    return F.struct(*[
        values.get(name, F.lit(None)).cast("string").alias(name) for name in RAW_FIELDS
    ])


@dataclass(frozen=True)
class RegexLayout:
    """A whole-line Java regex with named groups.

    ``ts`` is required and may not match empty. ``clock`` is a second part of
    the timestamp, ``request`` a request line still to be split, ``duration`` a
    number in ``unit`` (``ms`` or ``s``), ``message`` free text to look for an
    address, a status, a duration and a request in. ``pair_name`` is the
    format's name for lines in which the group ``pair`` takes part.
    """

    name: str
    pattern: str
    pair_name: str | None = None

    def groups(self) -> list[str]:
        return re.findall(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>", self.pattern)

    def __post_init__(self):
        names = self.groups()
        if "ts" not in names:
            raise ValueError(f"layout {self.name!r} needs a group named ts")
        unknown = set(names) - set(_GROUPS) - {"ts"}
        if unknown:
            raise ValueError(f"layout {self.name!r} has unknown groups {sorted(unknown)}")
        if any(m[1] in "123456789" for m in re.finditer(r"(?s)\\(.)", self.pattern)):
            raise ValueError(f"layout {self.name!r} refers to a group by number, which merging changes: use \\k<name>")


@dataclass(frozen=True)
class ColumnLayout:
    """Any function from the line to :func:`raw_struct`, NULL where it does not fit."""

    name: str
    recognise: Callable[[Column], Column]


@dataclass(frozen=True)
class JsonLayout:
    """One JSON object per line, its keys found through alias lists."""

    name: str = "json"
    keys: dict = field(default_factory=lambda: V.JSON_KEYS)


JSON = JsonLayout()
COMMON = RegexLayout("common", V.COMMON_LINE, pair_name="combined")
FIXED8 = RegexLayout("fixed8", V.FIXED8_LINE)
GENERIC = RegexLayout("generic", V.GENERIC_LINE)
#: Strict layouts first; the loosest one only sees what the others left.
DEFAULT_LAYOUTS = (JSON, COMMON, FIXED8, GENERIC)

Layout = RegexLayout | ColumnLayout | JsonLayout


# --- regex layouts ------------------------------------------------------------------


def _alternation(layouts: Sequence[RegexLayout]) -> tuple[str, str]:
    """One pattern for several layouts and the replacement that lists its groups.

    The replacement is an empty line, one line per layout for its timestamp,
    which tells the layouts apart, and one per shared group. A line of text
    holds no line break, so the parts cannot be confused.
    """
    # Each body is a group of its own, so that its inline flags end with it.
    bodies = [
        "(?:" + re.sub(r"(\(\?|\\k)<([a-zA-Z][a-zA-Z0-9]*)>", rf"\1<L{i}\2>", layout.pattern) + ")"
        for i, layout in enumerate(layouts)
    ]
    pattern = "^(?:" + "|".join(bodies) + r")\z"
    number = number_groups(pattern)
    slots = ["", *[f"${number[f'L{i}ts']}" for i in range(len(layouts))]]
    for name in _GROUPS:
        shared = [number.get(f"L{i}{name}") for i in range(len(layouts))]
        slots.append("".join(f"${n}" for n in shared if n))
    return pattern, "\n".join(slots)


def _regex_fields(parts: str, layouts: Sequence[RegexLayout]) -> dict[str, str]:
    """SQL for the fields in the split replacement; NULL throughout if nothing matched."""
    stamps = [f"get({parts}, {1 + i})" for i in range(len(layouts))]
    fields = {name: f"get({parts}, {1 + len(layouts) + i})" for i, name in enumerate(_GROUPS)}
    labels = []
    for stamp, layout in zip(stamps, layouts):
        if layout.pair_name:
            labels.append(
                f"when {stamp} is not null and {fields['pair']} is not null then '{layout.pair_name}'")
        labels.append(f"when {stamp} is not null then '{layout.name}'")
    fields["format"] = f"case {' '.join(labels)} end"
    fields["ts"] = f"coalesce({', '.join(stamps)})"
    fields["bytes"] = f"nullif({fields['bytes']}, '-')"
    return fields


def _from_message(df: DataFrame) -> DataFrame:
    """Fill fields the layout does not name from its free text, first hit each."""
    message = F.col("message")
    request, status = word_edges(V.MESSAGE_REQUEST), word_edges(V.MESSAGE_STATUS)
    number, unit = X.find_duration(message)
    found = {
        "ip": F.regexp_extract(message, word_edges(V.MESSAGE_IP), 0),
        "method": F.regexp_extract(message, request, 1),
        "url": F.regexp_extract(message, request, 2),
        "status": F.regexp_extract(message, status, 1),
        "duration": number,
        "unit": unit,
    }
    texts = F.transform(F.array(*found.values()), present)
    df = df.withColumn("_found", F.when(message.isNotNull(), texts))
    return df.withColumns({
        name: F.coalesce(name, F.get("_found", F.lit(i))) for i, name in enumerate(found)
    })


# --- JSON lines -------------------------------------------------------------------------

# Texts that may stand for a value that is not a string: numeric zero, false and
# empty containers count as absent, and true has its own spelling.
_ABSENT = r"^(?:-?0(?:\.0*)?(?:[eE].*)?|false|\[\s*\]|\{\s*\})\z"
_MAYBE_TYPED = r"^(?:-?0(?:\.0*)?(?:[eE].*)?|true|false|\[.*|\{.*)\z"
_END = "line_ends_here"


def _json_object(line: str, keys: dict, value_type: str) -> str:
    """SQL for the aliases of one JSON object. A key added behind the last one is
    only reached if the line is exactly one object, with nothing after it."""
    names = dict.fromkeys(name for aliases in keys.values() for name in aliases)
    columns = ", ".join(f"`{name}`: {value_type}" for name in names)
    head = rf"if({line} rlike r'^\{{\s*\}}\z', '{{', concat(left({line}, char_length({line}) - 1), ','))"
    return (
        f"""from_json(concat({head}, '"{_END}":1}}'), 'struct<{columns}, {_END}: int>', """
        "map('allowSingleQuotes', 'false'))"
    )


def _json_struct(line: str, layout: JsonLayout) -> Column:
    """Raw fields from the chosen values, which are in columns ``_<field>``."""
    typed = _json_object(line, layout.keys, "variant")

    def kind(name: str) -> str:
        # Only asked for the few texts below; the line is then read once more.
        chosen = " ".join(
            f"when nullif(_json.`{alias}`, '') is not null then schema_of_variant(typed.`{alias}`)"
            for alias in layout.keys[name])
        return f"transform(array({typed}), typed -> case {chosen} end)[0]"

    def truthy(name: str) -> Column:
        return F.expr(
            f"case when _{name} rlike r'{_MAYBE_TYPED}' then case when {kind(name)} = 'STRING' then _{name}"
            f" when _{name} rlike r'{_ABSENT}' then null when _{name} = 'true' then 'True' else _{name} end"
            f" else _{name} end")

    odd = F.expr(rf"case when _duration rlike r'^(?:true|false|\[.*|\{{.*)\z' then {kind('duration')} end")

    def duration(kind_of: Column) -> Column:
        value = F.col("_duration")
        number, unit = (F.when(F.contains(value, F.lit("s")), found) for found in X.find_duration(value))
        is_text = kind_of.isNull() | (kind_of == "STRING")
        as_number = F.when(kind_of == "BOOLEAN", F.when(value == "true", "1").otherwise("0"))
        return F.struct(
            F.when(is_text, F.coalesce(number, X.float_text(value))).otherwise(as_number).alias("number"),
            F.when(is_text, unit).alias("unit"))

    took = bind(odd, duration)
    return F.when(F.col("_json").getField(_END) == 1, raw_struct(
        format=F.lit(layout.name),
        **{name: truthy(name) for name in ("ts", "level", "ip", "method", "request", "bytes")},
        status=F.col("_status"),
        duration=took.getField("number"),
        unit=took.getField("unit"),
    ))


def _with_json(df: DataFrame, line: str, condition: Column, layout: JsonLayout, out: str) -> DataFrame:
    kept, text = df.columns, F.col(line)
    parsed = F.expr(_json_object(line, layout.keys, "string"))
    df = df.select(*kept, F.when(condition & text.startswith("{") & text.endswith("}"), parsed).alias("_json"))
    picks = []
    for name, aliases in layout.keys.items():
        values = ", ".join(f"nullif(_json.`{alias}`, '')" for alias in aliases)
        picks.append(f"coalesce({values}) as _{name}")
    df = df.select(*kept, *exprs("_json", *picks))
    return df.select(*kept, _json_struct(line, layout).alias(out))


# --- first match wins --------------------------------------------------------------------


def _merged(layouts: Sequence[Layout]) -> list[list[Layout]]:
    """Neighbouring regex layouts in one group, every other layout on its own."""
    groups: list[list[Layout]] = []
    for layout in layouts:
        joins = isinstance(layout, RegexLayout) and groups and isinstance(groups[-1][0], RegexLayout)
        if joins:
            groups[-1].append(layout)
        else:
            groups.append([layout])
    return groups


def with_raw_fields(
    df: DataFrame, line: str = "line", layouts: Sequence[Layout] = DEFAULT_LAYOUTS
) -> DataFrame:
    """Add the raw fields of the first layout that fits; NULL if none does.

    ``line`` must be stripped. A value with a line break in it is not a line
    and fits no layout.
    """
    kept, text = df.columns, F.col(line)
    unmatched = ~F.contains(text, F.lit("\n"))
    found: list[dict[str, str]] = []
    for k, group in enumerate(_merged(layouts)):
        out, first = f"_layout{k}", group[0]
        if isinstance(first, RegexLayout):
            pattern, replacement = _alternation(group)
            parts = replaced_parts(text, pattern, replacement, "\n")
            df = df.select(*df.columns, F.when(unmatched, parts).alias(out))
            found.append(_regex_fields(out, group))
            unmatched = unmatched & (F.size(out) < 2)
            continue
        if isinstance(first, JsonLayout):
            df = _with_json(df, line, unmatched, first, out)
        else:
            df = df.select(*df.columns, F.when(unmatched, first.recognise(text)).alias(out))
        found.append({name: f"{out}.{name}" for name in RAW_FIELDS})
        unmatched = unmatched & F.col(out).isNull()
    columns = []
    for name in [*RAW_FIELDS, "clock", "message"]:
        values = [fields[name] for fields in found if name in fields]
        columns.append(f"coalesce({', '.join([*values, 'cast(null as string)'])}) as {name}")
    df = df.select(*kept, *exprs(*columns))
    df = df.withColumn("ts", F.expr("if(clock is null, ts, concat(ts, ' ', clock))"))
    if any("message" in fields for fields in found):
        df = _from_message(df)
    return df.select(*kept, *RAW_FIELDS)
