"""Exact top-k by inner product with a pivot-distance index.

With M the largest length of a vector, x is extended by sqrt(M^2 - |x|^2) and a query
by 0. Extended vectors have equal length, so the largest inner product is the
smallest distance and the triangle inequality holds. Every vector is keyed by its
nearest pivot and its distance to it; the index is sorted by both and cut into blocks,
annuli around a pivot. A query first looks into the annuli around its own distance,
which bounds the distance of its k-th neighbour. From there the annuli of every pivot
are expanded as far as the bound reaches and no further: x can only be nearer than R
if its distance to the pivot differs from the query's by less than R, and if half the
amount by which its pivot is farther from the query than the query's own is less
than R. Queries travel in blocks to those annuli; no other pairs are formed.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logspark.llm.shared import land

#: Pivots, the vectors with the smallest hashes of their ids; all vectors are indexed.
PIVOTS = 32
#: Vectors of an index block, and queries that travel together.
BLOCK, QUERIES = 256, 64
SEED = 42
#: Sums of products must stay below this to be exact in 64-bit floating point.
LARGEST = float(1 << 53)
_LOG = logging.getLogger(__name__)
_BLOCK_TYPE = "pivot int, lo double, hi double, ids array<long>, dists array<double>, vecs array<long>, bounds array<double>"


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return np.asarray(flat).astype(np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray, longest: float, extended: bool) -> np.ndarray:
    """Distances of rows to pivots in the extended space; queries are extended by 0."""
    own = (x * x).sum(1)
    inner = x @ pivots.T
    if extended:
        rest = np.sqrt(np.maximum(longest - own, 0))
        far = np.sqrt(np.maximum(longest - (pivots * pivots).sum(1), 0))
        return np.sqrt(np.maximum(2 * longest - 2 * (inner + rest[:, None] * far), 0))
    return np.sqrt(np.maximum(own[:, None] + longest - 2 * inner, 0))


def _pack(rows: int, dim: int):
    """Maps sorted rows (pivot, dist, vec_id, v, bound) to blocks of one pivot each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def block():
            cols = [np.concatenate([h[i] for h in held]) for i in range(1, 5)]
            dist, ids, vecs, bounds = cols
            out = [held[0][0], float(dist.min()), float(dist.max()), ids.tolist(), dist.tolist(),
                   vecs.ravel().tolist(), bounds.tolist()]
            names = ["pivot", "lo", "hi", "ids", "dists", "vecs", "bounds"]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()),
                     pa.list_(pa.int64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            pivot = np.asarray(batch.column(0))
            vecs = np.asarray(batch.column(3).flatten()).reshape(-1, dim)
            dist, ids, bounds = (np.asarray(batch.column(i)) for i in (1, 2, 4))
            edges = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0][0] != int(pivot[a]):
                    yield block()
                    held = []
                while a < b:
                    take = min(b - a, rows - sum(len(h[1]) for h in held))
                    held.append((int(pivot[a]), *(x[a:a + take] for x in (dist, ids, vecs, bounds))))
                    a += take
                    if sum(len(h[1]) for h in held) == rows:
                        yield block()
                        held = []
        if held:
            yield block()

    return run


def _blocks(rows: DataFrame, size: int, dim: int, name: str) -> DataFrame:
    """``rows`` (pivot, dist, vec_id, v, bound) sorted by pivot and distance and cut into blocks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    packed = spread.select("pivot", "dist", "vec_id", "v", "bound").mapInArrow(_pack(size, dim), _BLOCK_TYPE)
    return land(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _best(q: np.ndarray, q_ids, bounds, x: np.ndarray, x_ids, k: int):
    """(query, row of x, score) of the k best of every query among those that reach its bound."""
    score = q @ x.T
    at, to = np.nonzero((score >= bounds[:, None]) & (q_ids[:, None] != x_ids[None, :]))
    s = score[at, to]
    order = np.lexsort((x_ids[to], -s, at))
    at, to, s = at[order], to[order], s[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], to[keep], s[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query, but for its own.

    Scores are inner products of ``floor(scale * x)``, ties go to the smaller id.
    Vectors that are null or hold null or infinite components, and rows without an id,
    take no part; shorter vectors, empty ones too, count as filled up with zeros. Rows
    with a query's id are its own. Repeated rows are candidates each; a repeated query is
    asked once. Vectors so long that a score could pass 2**53 are refused. How many of the
    pairs of blocks are visited is logged: few where vectors lie in clusters that are
    narrow against their distances, nearly all where they point in all directions.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    seen = rows.agg(F.max(F.size("v")).alias("dim"), F.max(length).alias("longest")).first()
    dim, longest = seen.dim or 1, float(seen.longest or 0.0)
    if longest >= LARGEST:
        raise ValueError("the squared length of a scaled vector reaches 2**53, so scores would not be exact")
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(pivots).collect()
    centres = np.array([r.v for r in chosen], np.float64).reshape(-1, dim)
    slack = 1e-6 * np.sqrt(longest) + 1e-3

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(1), dim), centres, longest, True)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *batch.columns,
                     pa.array(np.full(len(d), -np.inf))], ["pivot", "dist", "vec_id", "v", "asked", "bound"])

    placed = land(rows.mapInArrow(keyed, "pivot int, dist double, vec_id long, v array<long>, asked boolean, bound double"),
                  "pivot-rows")
    index = _blocks(placed, BLOCK, dim, "pivot-index")
    asked = placed.where("asked").dropDuplicates(["vec_id", "v"])
    asking = _blocks(asked, QUERIES, dim, "pivot-queries")

    def named(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[F.col(c).alias(mark + c) for c in ("block", "pivot", "lo", "hi", "ids", "dists", "vecs", "bounds")])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, x_ids, x = (np.asarray(batch.column(c)[i].values) for c in range(4))
                q, x = (v.astype(np.float64).reshape(-1, dim) for v in (q, x))
                score = np.where(q_ids[:, None] == x_ids, -np.inf, q @ x.T)
                kth = np.sort(score, 1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(kth)], ["vec_id", "kth"])

    near = named(asking, "q_").join(named(index, "x_"), (F.col("q_pivot") == F.col("x_pivot")) & (
        F.col("x_lo") <= F.col("q_hi")) & (F.col("q_lo") <= F.col("x_hi")))
    kth = (near.select("q_ids", "q_vecs", "x_ids", "x_vecs").mapInArrow(seeds, "vec_id long, kth double")
           .groupBy("vec_id").agg(F.max("kth").alias("kth")))
    bounded = asked.join(kth, "vec_id", "left").select(
        "pivot", "dist", "vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("bound"))
    asking = _blocks(bounded, QUERIES, dim, "pivot-bounded")

    def radius(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        reach = np.sqrt(np.maximum((q * q).sum(1) + longest - 2 * bounds, 0)) + slack
        return np.where(np.isneginf(bounds), np.inf, reach)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.array(r["vecs"], np.float64).reshape(-1, dim)
                d, reach = _distances(q, centres, longest, False), radius(q, np.array(r["bounds"]))[:, None]
                open_ = (d - d.min(1)[:, None]) / 2 <= reach
                low, high = np.where(open_, d - reach, np.inf).min(0), np.where(open_, d + reach, -np.inf).max(0)
                to = np.flatnonzero(open_.any(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(to), r["block"])), pa.array(to.astype(np.int32)), pa.array(low[to]), pa.array(high[to])],
                    ["q_block", "at_pivot", "low", "high"])

    visits = asking.select("block", "vecs", "bounds").mapInArrow(reached, "q_block long, at_pivot int, low double, high double")
    pairs = visits.join(index.select("block", "pivot", "lo", "hi"), (F.col("at_pivot") == F.col("pivot")) & (
        F.col("lo") <= F.col("high")) & (F.col("hi") >= F.col("low"))).select("block", "q_block")
    pairs = land(pairs, "pivot-pairs")
    _LOG.info("%d of %d pairs of blocks are visited", pairs.count(), asking.count() * index.count())
    payload = [F.col(c) for c in ("ids", "dists", "vecs", "bounds")]
    travelling = pairs.join(asking.select(F.col("block").alias("q_block"), *payload), "q_block").select(
        "block", F.lit(1).alias("kind"), F.lit(-1).alias("pivot"), *payload)
    waiting = index.select("block", F.lit(0).alias("kind"), "pivot", *payload)
    stream = waiting.unionByName(travelling).repartition("block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = x_ids = dists = centre = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in ("kind", "pivot", "ids", "dists", "vecs", "bounds")}
                ids = np.asarray(r["ids"].values)
                vecs = np.asarray(r["vecs"].values).astype(np.float64).reshape(-1, dim)
                if r["kind"].as_py() == 0:
                    x, x_ids, dists = vecs, ids, np.asarray(r["dists"].values)
                    centre = centres[r["pivot"].as_py()][None, :]
                    continue
                bounds = np.asarray(r["bounds"].values)
                d, reach = _distances(vecs, centre, longest, False)[:, 0], radius(vecs, bounds)
                a = np.searchsorted(dists, (d - reach).min(), "left")  # the annulus that any of them reaches
                b = np.searchsorted(dists, (d + reach).max(), "right")
                at, to, s = _best(vecs, ids, bounds, x[a:b], x_ids[a:b], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(x_ids[a:b][to]), pa.array(s.astype(np.int64))], ["query_id", "vec_id", "score"])

    found = stream.mapInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
