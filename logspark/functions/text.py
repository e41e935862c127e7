"""Regex and white-space helpers shared by all column functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.strip() and \s treat as white space in Unicode text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_WORD = r"[\p{L}\p{N}_]"
# Spelled out, because what \b means for letters outside ASCII depends on the JDK.
# Next to a word character an edge is a look-around on one side only.
_EDGES = {
    "{b}": rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "{<}": rf"(?<!{_WORD})",
    "{>}": rf"(?!{_WORD})",
}


def unicode_space(pattern: str) -> str:
    """Widen ``\\s`` and ``\\S`` in a Java pattern to Unicode white space."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        if token == r"\s":
            token = _SPACE if in_class else f"[{_SPACE}]"
        elif token == r"\S":
            token = f"[^{_SPACE}]"
        out.append(token)
        i += 2 if pattern[i] == "\\" else 1
    return "".join(out)


def word_edges(pattern: str) -> str:
    """Fill in the word boundaries ``{b}``, ``{<}`` and ``{>}`` of a pattern."""
    pattern = unicode_space(pattern)
    for mark, edge in _EDGES.items():
        pattern = pattern.replace(mark, edge)
    return pattern


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends."""
    # btrim measures the whole text; most lines start and end in a visible ASCII byte.
    first, last = (F.substring(c.cast("binary"), at, 1) for at in (1, -1))
    visible = [b.between(F.lit(b"!"), F.lit(b"~")) for b in (first, last)]
    return F.when(visible[0] & visible[1], c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def present(c: Column) -> Column:
    """NULL for an empty string: inside Spark an absent field is NULL."""
    return F.nullif(c, F.lit(""))


def number_groups(pattern: str) -> dict[str, int]:
    """Position of every named group among the capturing groups of a pattern."""
    named, count, in_class, i = {}, 0, False, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 2
            continue
        if char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        elif char == "(" and not in_class:
            name = re.match(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>", pattern[i:])
            if name or not pattern.startswith("(?", i):
                count += 1
            if name:
                named[name.group(1)] = count
        i += 1
    return named


def replaced_parts(c: Column, pattern: str, replacement: str, separator: str) -> Column:
    """Match once and split the replacement into parts, NULL where one is empty.

    Text that does not match comes back as a single part, and so does text that
    holds the separator, which no pattern may match. The lambda also keeps
    the projection out of whole-stage code, where it and its neighbours would
    end up in one method too large for the JIT compiler.
    """
    replaced = F.regexp_replace(c, unicode_space(pattern), replacement)
    parts = F.when(c.contains(separator), F.array(c)).otherwise(F.split(replaced, separator, -1))
    return F.transform(parts, present)


def exprs(*texts: str) -> list[Column]:
    """Columns from SQL text: one call for what would take hundreds as objects."""
    return [F.expr(text) for text in texts]


def bind(c: Column, body) -> Column:
    """Evaluate ``c`` once and hand it to ``body``, which may use it repeatedly."""
    return F.get(F.transform(F.array(c), body), F.lit(0))
