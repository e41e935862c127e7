"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles, in powers of two. The
sketch of an item is its smallest shingle hashes, so many that a text which holds
the wanted share of the item's shingles must hold one of them: more than the share
that may be missing. The sketch of a document for a partition is all of its
shingle hashes up to the largest one in the partition's item sketches, so it is as
long as the document demands, and no item is lost in a long text. Where sketches
share a hash, the shingles themselves are compared exactly.

Items are the queries: they are sent to the tasks in blocks, one after the other, each
of ``block_items`` at most and of about ``block_chars`` characters, and documents are
never shuffled. What a block finds is landed before the next one is sent, so the driver
holds one block, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.shared import fresh, land

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Items, and characters of their texts, sent to the tasks at a time.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 1 << 26
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class Shingled:
    """The word shingles of a text as byte ranges of ``joined``."""

    joined: bytes
    starts: list[int]
    ends: list[int]

    def __iter__(self) -> Iterator[bytes]:
        joined = self.joined
        return (joined[a:b] for a, b in zip(self.starts, self.ends, strict=True))


def shingled(text: str | None, words: int = SHINGLE_WORDS) -> Shingled:
    """Shingles of a text with A-Z in lower case; fewer words make one shingle, no word makes none."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return Shingled(b"", [], [])
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, k = max(1, len(found) - words + 1), min(words, len(found))
    return Shingled(b" ".join(found), starts[:n].tolist(), ends[k - 1:].tolist())


@dataclass
class Partition:
    """Sketches of the items of one size partition, by hash."""

    hashes: np.ndarray  # sorted, distinct
    first: np.ndarray  # items[first[i]:first[i + 1]] have hashes[i]
    items: np.ndarray


@dataclass
class Sketches:
    """Item sketches by size partition, and the distinct shingles of every item."""

    partitions: list[Partition]
    ids: list
    shingles: list[frozenset]


def sketch_items(rows: list[tuple], words: int, containment: float) -> Sketches:
    """Sketches of (item_id, text) rows, each of the length that its size partition needs."""
    ids, shingles, found = [], [], {}
    for item_id, text in rows:
        own = frozenset(shingled(text, words))
        if not own:
            continue
        largest = 1 << (len(own) - 1).bit_length()  # size of its partition
        length = int((1 - containment) * largest + 1e-9) + 1
        sketch = sorted(xxhash.xxh64_intdigest(s, SEED) for s in own)[:length]
        found.setdefault(largest, []).extend((h, len(ids)) for h in sketch)
        ids.append(item_id)
        shingles.append(own)
    partitions = []
    for _, pairs in sorted(found.items()):
        pairs.sort()
        h, i = (np.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), (np.uint64, np.int64), strict=True))
        distinct, first = np.unique(h, return_index=True)
        partitions.append(Partition(distinct, np.append(first, len(h)), i))
    return Sketches(partitions, ids, shingles)


def candidates_in(hashes: np.ndarray, sketches: Sketches) -> list[int]:
    """Items that share a hash with the text, whose sketch for a partition ends at that partition's largest hash."""
    found: set[int] = set()
    for p in sketches.partitions:
        own = hashes[hashes <= p.hashes[-1]]
        at = np.searchsorted(p.hashes, own)
        for a in np.unique(at[p.hashes[at] == own]).tolist():
            found.update(p.items[p.first[a]:p.first[a + 1]].tolist())
    return sorted(found)


def matches_in(text: str | None, sketches: Sketches, words: int, containment: float) -> list[tuple]:
    """(item, shared shingles, its shingles) of every item that ``text`` contains."""
    own = shingled(text, words)
    digest = xxhash.xxh64_intdigest
    candidates = candidates_in(np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own.starts)), sketches)
    text_shingles, out = frozenset(own) if candidates else (), []
    for c in candidates:
        item = sketches.shingles[c]
        shared = len(item & text_shingles)
        if shared >= containment * len(item) - 1e-9:
            out.append((sketches.ids[c], shared, len(item)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", words: int = SHINGLE_WORDS,
                 containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of documents that hold an item's shingles.

    A text of fewer than ``words`` words is one shingle. Null and empty items and
    texts match nothing. Repeated documents give repeated rows, repeated items (same
    id and text) one; an item without an id is reported with a null id.
    """
    spark = docs.sparkSession
    wanted = land(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(
        "text IS NOT NULL").distinct(), "benchmark-items")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // block_items), -(-size.chars // block_chars))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "item_id", "shared", "item_shingles")])
    out = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(sketch_items([tuple(r) for r in part.collect()], words, containment))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(doc.as_py(), *m) for doc, text in zip(batch.column(0), batch.column(1), strict=True)
                         for m in matches_in(text.as_py(), sent.value, words, containment)]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

        found = land(rows.mapInArrow(run, schema), "contaminated")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id has a match; rows without an id stay."""
    name, = fresh(docs, "matched_id")
    ids = contaminated(docs, items, doc_id, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col(doc_id).cast("long") == F.col(name), "left_anti")
