"""Chat records of many layouts in one template, by schema fingerprints.

A record is a JSON object. Which of the known nested fields it has, as a sorted list
of paths, is hashed; the hash selects a declarative mapping that turns the record
into turns. A mapping has one hash for every choice of its optional fields. Turns
are formatted with control strings around each; such strings inside roles and texts
are escaped reversibly. All of it is made of column functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known fields; those of lists hold one message an element.
TEXTS = ("system", "context", "prompt", "completion", "response", "instruction", "input", "output", "question", "answer")
LISTS = {"messages": ("role", "content"), "conversations": ("from", "value"), "dialogue": ("speaker", "text")}
#: Speakers under other names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are: a list of messages, or (role, fields joined by an empty line)."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ("system",)
    messages: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def paths(self) -> list[str]:
        """The path lists of the layout, one for each choice of its optional fields."""
        fields = [self.needs + some for k in range(len(self.may) + 1) for some in combinations(self.may, k)]
        return [",".join(sorted(f)) for f in fields]


def _listed(name: str) -> Mapping:
    role, text = LISTS[name]
    return Mapping(name, (name, f"{name}[].{role}", f"{name}[].{text}"), messages=name)


MAPPINGS = (
    *map(_listed, LISTS),
    Mapping("prompt_completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("system", "input"),
            turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question", ("question", "answer"), ("system", "context"),
            turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)

# The template.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: The first characters of control strings, where one begins, and what they are written as.
ESCAPES = ((r"<(?=\||/?s>|</?SYS>>)", "<", "\\l"), (r"\[(?=/?INST\])", "[", "\\o"))


def parse(record: Column) -> Column:
    """The known fields of a JSON record; null where it is no JSON object."""
    lists = ",".join(f"{k} array<struct<`{r}`:string,`{t}`:string>>" for k, (r, t) in LISTS.items())
    options = {"maxStringLen": str(2**31 - 1), "mode": "PERMISSIVE"}
    return F.from_json(record, ",".join(f"{t} string" for t in TEXTS) + "," + lists, options)


def paths(parsed: Column) -> Column:
    """The nested paths of the known fields that a record has, sorted and comma-joined."""
    found = [F.when(parsed[t].isNotNull(), F.lit(t)) for t in TEXTS]
    for name, fields in LISTS.items():
        found.append(F.when(parsed[name].isNotNull(), F.lit(name)))
        for f in fields:
            has = F.exists(parsed[name], lambda m: m[f].isNotNull())  # noqa: B023
            found.append(F.when(has, F.lit(f"{name}[].{f}")))
    return F.array_join(F.array_sort(F.filter(F.array(*found), lambda p: p.isNotNull())), ",")


def fingerprint(parsed: Column) -> Column:
    return F.xxhash64(paths(parsed))


def select_layout(mark: Column) -> Column:
    """The name of the mapping that a fingerprint selects, null for none."""
    chosen = F.lit(None).cast("string")
    for m in MAPPINGS:
        chosen = F.when(mark.isin(*[F.xxhash64(F.lit(p)) for p in m.paths()]), F.lit(m.name)).otherwise(chosen)
    return chosen


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns(parsed: Column, layout: Column) -> Column:
    """array<struct<role, text>> by the mapping of the layout; null where there is none."""
    system = F.when(parsed["system"].isNotNull(), F.array(_turn(F.lit("system"), parsed["system"]))).otherwise(
        F.array().cast("array<struct<role:string,text:string>>"))
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    out = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in MAPPINGS:
        if m.messages:
            role, text = LISTS[m.messages]
            known = (lambda r: r) if role == "role" else (lambda r: F.coalesce(F.try_element_at(names, r), r))
            own = F.transform(parsed[m.messages], lambda x: _turn(known(x[role]), x[text]))  # noqa: B023
        else:
            own = F.array(*[_turn(F.lit(r), F.concat_ws("\n\n", *[parsed[f] for f in fields])) for r, fields in m.turns])
        out = F.when(layout == m.name, F.concat(system, own)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    """Text in which no control string is left; a backslash always begins one of \\e, \\l, \\o."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for pattern, _, written in ESCAPES:
        text = F.regexp_replace(text, F.lit(pattern), F.lit("\\" + written))
    return text


def unescape(text: Column) -> Column:
    for _, char, written in ESCAPES:
        text = F.replace(text, F.lit(written), F.lit(char))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role has no line feed, which ends it in the template."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\w"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\w"), F.lit("\n")))


def format_turns(all_turns: Column) -> Column:
    """All turns in the template: opening mark, role, line feed, text, closing mark."""
    return F.array_join(F.transform(all_turns, lambda t: F.concat(
        F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), "")


def loss_mask(all_turns: Column) -> Column:
    """The mask by turn, in characters of its part of the template: ``take`` after ``skip``, for answers only."""
    return F.transform(all_turns, lambda t: F.struct(
        (F.lit(len(OPEN) + 1) + F.length(escape_role(t["role"]))).alias("skip"),
        F.when(t["role"] == "assistant", F.length(escape(t["text"]))).otherwise(0).alias("take")))


def _parts(formatted: Column) -> Column:
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    def turn(part):
        at = F.instr(part, F.lit("\n"))
        return F.struct(unescape_role(F.substring(part, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
                        unescape(F.substring(part, at + 1, F.length(part))).alias("text"))

    return F.transform(_parts(formatted), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """What lies under the mask, unescaped, one element a turn."""
    return F.zip_with(_parts(formatted), mask, lambda part, m: unescape(F.substring(part, m["skip"] + 1, m["take"])))
