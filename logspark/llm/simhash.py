"""Near duplicates by SimHash: fingerprints, trie self-join, components.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word
shingles. Equal fingerprints are collapsed first, so exact copies cost one row.
Two fingerprints at most ``max_bits`` apart agree in one of ``max_bits + 1``
blocks. For each block there is a trie over the fingerprints rotated so that the
block leads; node pairs start at the nodes below the leading block, descend bit
by bit together, add up the bits in which they differ, and are dropped once
these exceed ``max_bits``. Pairs whose nodes lie in one component already are
not descended any further, so a group of near copies yields a spanning forest
and not all its pairs. A node with more than ``node_rows`` fingerprints is first
split into node pairs deeper down by joins, so that no task holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import fresh, land

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that one node pair may bring into a task.
NODE_ROWS = 100_000
#: Bits by which a node with more fingerprints is split.
STEP = 8
SALTS = 16
#: Shingles hashed, and node pairs descended, at a time.
CHUNK = 1 << 16
FRONTIER = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a text, unsigned; 0 where it has no word."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    ends = ends[min(shingle_words, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        spans = zip(starts[i:min(n, i + CHUNK)].tolist(), ends[i:i + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; null and empty texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle_words, seed) for t in batch.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each ``i`` and ``j``; the smallest position wins."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def descend(values: np.ndarray, pairs: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Component label (smallest position) of every value, by descending node pairs.

    ``values`` (unsigned) are sorted within each node. A row of ``pairs`` is two
    nodes as position ranges and the bits in which they differ so far; the bits
    above ``depth`` are decided already.
    """
    labels = np.arange(len(values))
    changes, fresh_labels = None, False
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, pairs)]
    while stack:
        depth, p = stack.pop()
        if len(p) > FRONTIER:
            stack += [(depth, p[len(p) // 2:]), (depth, p[:len(p) // 2])]
            continue
        if fresh_labels:
            changes, fresh_labels = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1]))), False
        if changes is not None:
            one = (changes[p[:, 1] - 1] == changes[p[:, 0]]) & (changes[p[:, 3] - 1] == changes[p[:, 2]])
            p = p[~(one & (labels[p[:, 0]] == labels[p[:, 2]]))]
        p = p[(p[:, 0] != p[:, 2]) | (p[:, 1] - p[:, 0] > 1)]
        leaf = (p[:, 1] - p[:, 0] == 1) & (p[:, 3] - p[:, 2] == 1)
        i, j = p[leaf, 0], p[leaf, 2]
        near = np.bitwise_count(values[i] ^ values[j]) <= max_bits
        if near.any():
            labels, fresh_labels = _union(labels, i[near], j[near]), True
        p = p[~leaf]
        if not len(p):
            continue
        if depth not in ones:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        count, (a0, a1, b0, b1, used) = ones[depth], p.T
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        apart = a0 != b0
        nexts = [np.stack((a0, am, b0, bm, used), 1), np.stack((am, a1, bm, b1, used), 1),
                 np.stack((a0, am, bm, b1, used + 1), 1),
                 np.stack((am, a1, b0, bm, used + 1), 1)[apart]]
        nexts = np.concatenate(nexts)
        keep = (nexts[:, 0] < nexts[:, 1]) & (nexts[:, 2] < nexts[:, 3]) & (nexts[:, 4] <= max_bits)
        if keep.any():
            stack.append((depth + 1, nexts[keep]))
    return labels


def _node_links(max_bits: int):
    """Maps rows sorted by (node pair, side, value) to links within each node pair."""
    def links(table: pa.Table) -> pa.RecordBatch:
        depth, pair, used, side, value, rep = (table.column(c).to_numpy() for c in range(6))
        values = value.view(np.uint64) ^ np.uint64(1 << 63)  # the sort was signed
        n = len(pair)
        new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (side[1:] != side[:-1]), [True]))
        at = np.flatnonzero(new)
        lo, hi = at[:-1], at[1:]
        other = np.minimum(np.arange(len(lo)) + 1, len(lo) - 1)
        crossed = (side[lo] == 0) & (side[lo[other]] == 1) & (pair[lo] == pair[lo[other]])
        # A node pair of one node holds side 0 only and is paired with itself.
        own = (side[lo] == 0) & ~crossed & (used[lo] == 0)
        labels = np.arange(n)
        for d in np.unique(depth[lo]):
            alone, first = np.flatnonzero(own & (depth[lo] == d)), np.flatnonzero(crossed & (depth[lo] == d))
            rows = [np.stack((lo[m], hi[m], lo[q], hi[q], used[lo[m]]), 1)
                    for m, q in ((alone, alone), (first, first + 1))]
            labels = _union(labels, np.arange(n), descend(values, np.concatenate(rows), int(d), max_bits))
        far = np.flatnonzero(labels != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[labels[far]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            pair = table.column(1).to_numpy()
            cut = np.flatnonzero(pair != pair[-1])
            if len(cut):  # what follows the last whole node pair waits for more rows
                yield links(table.slice(0, int(cut[-1]) + 1))
                held = table.slice(int(cut[-1]) + 1).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _split(members: DataFrame, big: DataFrame, width: int, max_bits: int, node_rows: int) -> DataFrame:
    """Rows of the node pairs below nodes that are too large for one task.

    ``members`` (trie, node, value, rep); ``big`` (trie, node). Level by level the
    children of a node pair are joined through their parents; pairs over the
    budget are pruned, and those small enough are sent to their task.
    """
    rows = land(members.join(big, ["trie", "node"], "left_semi"), "simhash-large")
    prefix = lambda d: F.expr(f"shiftrightunsigned(value ^ {-1 << 63}L, {64 - d})") if d < 64 else F.expr(f"value ^ {-1 << 63}L")
    pairs = big.select("trie", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("used"))
    depth, done = width, []
    while depth < 64:
        below = min(64, depth + STEP)
        kids = rows.groupBy("trie", prefix(depth).alias("up"), prefix(below).alias("kid")).count()
        one = kids.select("trie", F.col("up").alias("a"), F.col("kid").alias("ka"), F.col("count").alias("na"))
        two = kids.select("trie", F.col("up").alias("b"), F.col("kid").alias("kb"), F.col("count").alias("nb"))
        used = F.col("used") + F.bit_count(
            F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND(F.lit((1 << (below - depth)) - 1)))
        pairs = (pairs.join(one, ["trie", "a"]).join(two, ["trie", "b"])
                 .where((F.col("a") != F.col("b")) | (F.col("ka") <= F.col("kb")))
                 .select("trie", F.col("ka").alias("a"), F.col("kb").alias("b"), used.alias("used"), "na", "nb")
                 .where((F.col("used") <= max_bits) & ~((F.col("a") == F.col("b")) & (F.col("na") == 1))))
        pairs = land(pairs, "simhash-pairs")
        large = (F.col("na") + F.col("nb") > node_rows) & F.lit(below < 64)
        small = pairs.where(~large).withColumn("pair", F.xxhash64("trie", F.lit(below), "a", "b"))
        member = rows.select("trie", prefix(below).alias("p"), "value", "rep")
        for side, node in ((0, "a"), (1, "b")):
            wanted = small if side == 0 else small.where("a != b")
            done.append(wanted.join(member.withColumnRenamed("p", node), ["trie", node]).select(
                F.lit(below).alias("depth"), "pair", "used", F.lit(side).alias("side"), "value", "rep"))
        pairs, depth = pairs.where(large).select("trie", "a", "b", "used"), below
        if pairs.isEmpty():
            break
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def near_links(reps: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (u, v) between ``rep`` of ``reps`` (fp, rep; both unique) that span every component."""
    width = 64 // (max_bits + 1)
    turned = F.expr("shiftleft(fp, s) | shiftrightunsigned(fp, 64 - s)")
    tries = F.explode(F.array(*[F.lit(t) for t in range(max_bits + 1)]))
    members = (reps.select("fp", "rep", tries.alias("trie")).withColumn("s", F.col("trie") * width)
               .withColumn("turned", F.when(F.col("s") == 0, F.col("fp")).otherwise(turned))
               .select("trie", F.expr(f"shiftrightunsigned(turned, {64 - width})").alias("node"),
                       F.expr(f"turned ^ {-1 << 63}L").alias("value"), "rep"))
    sizes = members.groupBy("trie", "node").count()
    big = land(sizes.where(F.col("count") > node_rows).select("trie", "node"), "simhash-big")
    rows = members.join(big, ["trie", "node"], "left_anti").select(
        F.lit(width).alias("depth"), (F.col("trie") * F.lit(1 << width) + F.col("node")).alias("pair"),
        F.lit(0).alias("used"), F.lit(0).alias("side"), "value", "rep")
    if not big.isEmpty():
        rows = rows.unionByName(_split(members, big, width, max_bits, node_rows))
    rows = rows.repartition("pair").sortWithinPartitions("pair", "side", "value")
    return rows.mapInArrow(_node_links(max_bits), "u long, v long")


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``least`` (u, m) of ``u``; a node with many edges is spread over salts."""
    salt = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(
        least.withColumn("salt", salt), ["u", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots, the smallest nodes of components.

    Alternates large-star and small-star steps until no edge changes.
    """
    edges = land(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u != v").distinct(), "simhash-edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select("u", F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = land(large, "simhash-large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = land(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "simhash-edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` bits. Null and empty texts have fingerprint 0 and link like others.
    Repeated rows stay. A row without a doc_id gets the component of rows with the
    same fingerprint (null if none has an id) and links nothing itself.
    """
    prints = land(fingerprints(docs, id_col, text_col, shingle_words, seed), "simhash-fp")
    reps = land(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = components(near_links(reps, max_bits))
    named = land(reps.join(roots, reps.rep == roots.u, "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")), "simhash-named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` with the smallest id of their group, and one row of each id.

    Rows without an id cannot be told apart and stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    id_name, = fresh(docs, "kept_id")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_name)).distinct()
    held = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col).cast("long") == F.col(id_name), "left_semi")
    return held.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))


def hex_fingerprint(fp):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


