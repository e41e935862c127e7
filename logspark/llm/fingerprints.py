"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every length, the polynomial of its first code
points modulo two primes. The difference of two prefixes, moved by a power of the base,
hashes any span, so spans of any texts are compared without reading them again, an edited
text is hashed from the arrays of the texts it was put together from, and the longest
common extension of two places is found by binary search.

A fingerprint holds the length, the hash of the whole text and marks: short hashes of the
beginnings and of the ends whose length is a multiple of a step, a power of two that
grows with the text, so that there are at most ``MARKS`` of either. The marks of two
fingerprints at their larger step are comparable; how far the beginnings agree, and the
ends, is again found by binary search, as texts that share a beginning share all shorter ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.shared import land

#: The primes and the bases; hashes below 2**31, so products fit 64 bits.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_290_816_673, 904_411_207)
#: Beginnings, and ends, that a fingerprint has marks of at most.
MARKS = 64
#: Code points hashed at a time.
CHUNK = 1 << 18
#: Key ranges for every task that pairs documents with their successors.
RANGES = 4


class Powers:
    """Powers of a base and of its inverse modulo a prime, made as far as they are asked for."""

    def __init__(self, base: int, prime: int):
        self.prime = prime
        self.steps = (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.uint32), np.ones(1, np.uint32)]

    def upto(self, n: int, inverse: bool = False) -> np.ndarray:
        table, step = self.tables[inverse], self.steps[inverse]
        while len(table) <= n:
            factor = np.uint64(pow(step, len(table), self.prime))
            table = np.concatenate([table, (table * factor % np.uint64(self.prime)).astype(np.uint32)])
        self.tables[inverse] = table
        return table


POWERS = tuple(Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(
        text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass(frozen=True)
class Prefixes:
    """Prefix hashes of a text: ``sums[k][i]`` is that of its first ``i`` code points modulo prime ``k``."""

    sums: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes, sums = code_points(text), []
        for powers in POWERS:
            prime, table = np.uint64(powers.prime), powers.upto(len(codes))
            out = np.zeros(len(codes) + 1, np.uint32)
            for i in range(0, len(codes), CHUNK):
                part = codes[i:i + CHUNK].astype(np.uint64) + np.uint64(1)
                part = part * table[i:i + len(part)] % prime
                out[i + 1:i + 1 + len(part)] = (np.cumsum(part, dtype=np.uint64) + out[i]) % prime
            sums.append(out)
        return cls(tuple(sums))

    def __len__(self) -> int:
        return len(self.sums[0]) - 1

    def spans(self, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the spans, the same wherever a span lies; arrays of places are welcome."""
        out = []
        for powers, sums in zip(POWERS, self.sums, strict=True):
            prime, inverse = np.uint64(powers.prime), powers.upto(len(self), inverse=True)
            inside = (sums[end].astype(np.uint64) + prime - sums[start]) % prime
            out.append(inside * inverse[start] % prime)
        return tuple(out)

    def same(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        """Whether two spans are equal."""
        return self.spans(start, start + length) == other.spans(other_start, other_start + length)

    def extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """The length of the longest common extension of two places."""
        low, high = 0, min(len(self) - start, len(other) - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(start, other, other_start, middle) else (low, middle - 1)
        return low

    def joined(self, cut: int, other: Prefixes, length: int) -> Prefixes:
        """The prefixes of the first ``cut`` code points followed by ``other``'s first ``length``."""
        out = []
        for powers, own, more in zip(POWERS, self.sums, other.sums, strict=True):
            prime, table = np.uint64(powers.prime), powers.upto(cut)
            moved = (more[1:length + 1] * np.uint64(table[cut]) + np.uint64(own[cut])) % prime
            out.append(np.concatenate([own[:cut + 1], moved.astype(np.uint32)]))
        return Prefixes(tuple(out))


def _step(length: int) -> int:
    """The smallest power of two of which at most ``MARKS`` multiples lie in a text."""
    return 1 << max(0, -(-length // MARKS) - 1).bit_length()


def fingerprint(prefixes: Prefixes) -> str:
    """``length:hash:marks of beginnings:marks of ends``, in hexadecimal digits."""
    n = len(prefixes)
    at = np.arange(_step(n), n + 1, _step(n))
    begins, ends = prefixes.spans(np.zeros_like(at), at), prefixes.spans(n - at, np.full_like(at, n))
    short = lambda h: ((h[0] ^ (h[1] << np.uint64(5))) & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()
    whole = [int(h) for h in prefixes.spans(0, n)]
    return f"{n:x}:{whole[0]:08x}{whole[1]:08x}:{short(begins)}:{short(ends)}"


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Up to which mark both agree: by binary search, each probe reading a mark and the one before."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        same = (a[max(0, middle - 2):middle] == b[max(0, middle - 2):middle]).all()
        low, high = (middle, high) if same else (low, middle - 1)
    return low


def likeness(one: str, other: str) -> float:
    """From 0 to 1: the share of the longer text that lies in a common beginning or a common end."""
    (n, h, *marks), (m, g, *more) = one.split(":"), other.split(":")
    if (n, h) == (m, g):
        return 1.0
    n, m = int(n, 16), int(m, 16)
    step = max(_step(n), _step(m))
    shared = 0
    for a, b in zip(marks, more, strict=True):
        a, b = (np.frombuffer(bytes.fromhex(x), ">u2")[step // _step(k) - 1::step // _step(k)] for x, k in ((a, n), (b, m)))
        shared += _agreement(a, b) * step
    return min(shared, n, m) / max(n, m)


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def ranges(keys: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut (id) into about ``parts`` ranges of equal size; one that many rows have occurs repeatedly."""
    shares = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), F.lit(5 * parts)).alias("at")).first().at
    return np.sort(np.array(found or [], np.int64))[::-1]


def successors(docs: DataFrame, edit, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edit`` of (id, text, next text) for all rows, next by falling id; the last one's next is the first.

    Rows are dealt into ranges of (id, text hash) and sorted there, and the first rows of
    every range are also sent to the one before, so that whole texts are shuffled once
    and no task sees more than its ranges. Rows without an id come last, as
    with the smallest one; rows with equal ids are ordered by a hash of their text, so
    they too spread over several ranges.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.cast("binary").alias("text")).select(
        "doc", F.coalesce("doc", lowest).alias("id"), F.xxhash64("text").alias("tie"), "text")
    cuts = ranges(docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("id")), RANGES * tasks)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        down, up = ~ids.to_numpy(np.int64), ~cuts  # turns the order, also of the smallest number
        before, upto = np.searchsorted(up, down, "left"), np.searchsorted(up, down, "right")
        place = (ties.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series((before + np.minimum(place * (upto - before + 1), upto - before).astype(np.int64)).astype(np.int32))

    placed = rows.withColumn("range", range_of("id", "tie"))
    order = (F.desc("id"), "tie")
    # The first (id, tie) of every range: one row a range, and the range that comes before it.
    heads = placed.groupBy("range").agg(F.max(F.struct("id", (-1 - F.col("tie")).alias("turned"))).alias("head"))
    circle = Window.orderBy("range")
    last = F.max("range").over(Window.partitionBy())
    heads = land(heads.select(F.col("range").alias("head_range"), F.col("head.id").alias("head_id"),
                              (-1 - F.col("head.turned")).alias("head_tie"),
                              F.coalesce(F.lag("range").over(circle), last).alias("to")), "fingerprint-heads")
    # ``heads`` has at most RANGES rows for every task, whatever the data.
    met = placed.join(F.broadcast(heads), (F.col("range") == F.col("head_range")) & (F.col("id") == F.col("head_id")) & (
        F.col("tie") == F.col("head_tie")), "left")
    own = F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("to").alias("at"), F.lit(True).alias("guest"))
    sent = met.select("doc", "id", "tie", "text", F.inline(
        F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    return sent.repartition(tasks, "at").sortWithinPartitions("at", "guest", *order).select("at", "guest", "doc", "text").mapInArrow(
        *edit)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc, text, prefixes, next text, its prefixes) of the rows that are no guests."""
    held = None
    for at, guest, doc, raw in _rows(batches):
        if guest and (held is None or held[0] != at):
            continue  # only the first guest closes its range
        text = _text(raw)
        prefixes = held[3] if held is not None and held[2] == text else Prefixes.of(text)
        if held is not None:
            yield *held[1:], text, prefixes
        held = None if guest else (at, doc, text, prefixes)


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in (
    "edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_parts(text: str, following: str) -> tuple[int, int]:
    """(code points kept, code points taken from the next text) of the edited text."""
    cut = len(text) // 3
    return len(text) - cut, min(cut, len(following))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, marks = [], (None, "")

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _TYPES, strict=True)], schema=_TYPES)

    for doc, text, own, following, after in _pairs(batches):
        mine = marks[1] if marks[0] is own else fingerprint(own)
        theirs = mine if after is own else fingerprint(after)
        marks = (after, theirs)
        keep, take = edited_parts(text, following)
        edited = fingerprint(own.joined(keep, after, take))
        digest = hashlib.sha256((text[:keep] + following[:take]).encode("utf-8", "surrogatepass")).hexdigest()
        held.append((doc, len(text), digest, mine, edited, likeness(mine, edited), likeness(mine, theirs)))
        if len(held) == 512:
            yield batch()
            held = []
    if held:
        yield batch()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the row's own with its last third replaced by as much of the next
    document's beginning. Null texts count as empty, and an empty text's edited one is
    empty too; empty texts are fully alike. Repeated rows return each, and are each
    other's next; rows without an id come after all others. A lone document is its own
    next. A task holds two texts and 8 bytes for each of their code points.
    """
    return successors(docs, (_edit, COLUMNS), id_col, text_col)
