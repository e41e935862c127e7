"""Whitening of embeddings from an exact scatter matrix, counted bit by bit.

Entries become integers, ``floor(scale * c) + offset``. Less each dimension's minimum
they are non-negative numbers of few bits. The same bit of a dimension over many rows
is a bit plane, packed into 64-bit words; a sum of products is then a sum of
``2 ** (b + c) * popcount(plane_b & plane_c)``, so cross-products and sums are exact
integers whatever the number of rows and the order in which tasks end. Each task counts
the planes of its rows block by block and hands on one number for each pair of dimensions
and power range; their totals, ``dims * dims`` numbers whatever the rows, are centred as
integers on the driver, ``n * sum(x * y) - sum(x) * sum(y)``, and only then divided and
decomposed. Rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import land

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows whose bit planes are held and intersected at a time.
BLOCK_ROWS = 1 << 16
#: Powers of two that share one 64-bit counter.
LIMB = 24
#: A scaled entry must stay below this to be an exact 64-bit integer.
LARGEST = float(1 << 62)
#: Results made of an Arrow batch at a time, in rows.
SLICE = 4096


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: integer sums, and the components by falling eigenvalue."""

    n: int
    low: list[int]
    sums: list[int]  # of the entries less ``low``
    widest: int  # the largest entry less its ``low``
    vectors: np.ndarray  # one column a component
    values: np.ndarray
    trace: float

    @property
    def varying(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * len(self.low) * np.finfo(float).eps

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace else np.zeros_like(self.values)

    def projection(self) -> np.ndarray:
        scaled = np.where(self.varying, self.values, 1.0)
        return self.vectors * np.where(self.varying, 1 / np.sqrt(scaled), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        y = x - np.array(self.low, np.int64)
        if self.n * max(1, self.widest) * 2 < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        """The sum of squares of every row, exact."""
        if len(self.low) * (self.n * max(1, self.widest)) ** 2 >= 1 << 63:
            centred = centred.astype(object)
        return (centred * centred).sum(1)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column as rows; shorter ones are filled up with what 0 becomes."""
    flat = np.asarray(column.flatten())
    lengths = np.asarray(pc.list_value_length(column))
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(lengths), dim), OFFSET, np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors that are whole and finite, as integers, landed once."""
    whole = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            scaled = np.floor(np.asarray(v.flatten()) * SCALE)
            if len(scaled) and not np.abs(scaled).max() < LARGEST:
                raise ValueError(f"entries times {SCALE} must be below {LARGEST:g} in size to become 64-bit integers")
            lengths = np.asarray(pc.list_value_length(v), np.int64)
            x = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()),
                                         pa.array(scaled.astype(np.int64) + OFFSET))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return land(rows.mapInArrow(run, f"id {kind}, x array<long>"), "whitening-rows")


def extents(rows: DataFrame) -> tuple[int, list[int], list[int]]:
    """(number of rows, lowest, highest entry of every dimension)."""
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), dim)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)],
                                             ["d", "low", "high"])

    found = rows.select("x").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()
    found = sorted(found, key=lambda r: r.d)
    return n, [r.low for r in found], [r.high for r in found]


class PlaneCounts:
    """Weighted popcounts of the bit planes of one task's rows, block by block."""

    def __init__(self, low: list[int], high: list[int]):
        bits = [(b - a).bit_length() for a, b in zip(low, high, strict=True)]
        self.low = np.array(low, np.int64)
        self.dim_of = np.repeat(np.arange(len(bits)), bits)
        self.bit_of = np.concatenate([np.arange(b) for b in bits]) if bits else np.zeros(0, np.int64)
        self.limbs = 2 * max(bits, default=0) // LIMB + 1
        self.products = np.zeros((self.limbs, len(bits), len(bits)), np.int64)
        self.sums = np.zeros((self.limbs, len(bits)), np.int64)

    def planes(self, x: np.ndarray) -> np.ndarray:
        """One row of 64-bit words for each dimension and bit."""
        y = np.ascontiguousarray((x - self.low).T)
        words = -(-x.shape[0] // 64)
        out = np.zeros((len(self.dim_of), words * 8), np.uint8)
        for p, (d, b) in enumerate(zip(self.dim_of.tolist(), self.bit_of.tolist(), strict=True)):
            packed = np.packbits((y[d] >> b).astype(np.uint8) & 1)
            out[p, :len(packed)] = packed
        return out.view(np.uint64)

    def add(self, x: np.ndarray) -> None:
        planes = self.planes(x)
        for p, (d, b) in enumerate(zip(self.dim_of.tolist(), self.bit_of.tolist(), strict=True)):
            counts = np.bitwise_count(planes[p:] & planes[p]).sum(1, dtype=np.int64)
            dims, power = self.dim_of[p:], self.bit_of[p:] + b
            both_ways = (dims == d).astype(np.int64)  # of one dimension, b with c and c with b
            both_ways[0] = 0
            np.add.at(self.products, (power // LIMB, d, dims), counts << (power % LIMB + both_ways))
            self.sums[b // LIMB, d] += int(counts[0]) << (b % LIMB)

    def table(self) -> pa.RecordBatch:
        """(i, j, limb, value), with the plain sums under j = -1."""
        limb, i, j = np.nonzero(self.products)
        limb_1, i_1 = np.nonzero(self.sums)
        columns = (np.append(i, i_1), np.append(j, np.full(len(i_1), -1)), np.append(limb, limb_1))
        values = np.append(self.products[limb, i, j], self.sums[limb_1, i_1])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(values)],
                                          ["i", "j", "limb", "value"])


def scatter(rows: DataFrame, low: list[int], high: list[int], block_rows: int = BLOCK_ROWS) -> tuple[list[int], dict]:
    """Sums, and sums of products for i <= j, of the entries less ``low``; Python integers."""
    dim = len(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = PlaneCounts(low, high), [], 0
        for batch in batches:
            x = _rows(batch.column(0), dim)
            while len(x):
                held.append(x[:block_rows - size])
                x, size = x[block_rows - size:], size + len(held[-1])
                if size == block_rows:
                    counts.add(np.concatenate(held))
                    held, size = [], 0
        if size:
            counts.add(np.concatenate(held))
        yield counts.table()

    parts = rows.select("x").mapInArrow(run, "i int, j int, limb int, value long")
    totals = parts.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums, products = [0] * dim, {}
    for r in totals:
        value = int(r.value) << (LIMB * r.limb)
        if r.j < 0:
            sums[r.i] += value
        else:
            products[r.i, r.j] = products.get((r.i, r.j), 0) + value
    return sums, products


def fit(rows: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> Whitening:
    """The whitening of all :func:`integer_rows`."""
    n, low, high = extents(rows)
    dim = len(low)
    sums, products = scatter(rows, low, high, block_rows) if dim else ([], {})
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):  # integers up to the division, which rounds once
            cov[i, j] = cov[j, i] = (n * products.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov) if dim else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    if dim:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    widest = max((b - a for a, b in zip(low, high, strict=True)), default=0)
    return Whitening(n, low, sums, widest, vectors, values[order], float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, over components with variance."""
    dim, kept = len(model.low), np.flatnonzero(model.varying)
    if not len(kept):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((len(kept), len(kept))), np.zeros(len(kept))
        for batch in batches:
            centred = model.centred(_rows(batch.column(0), dim)).astype(np.float64) / model.n
            w = centred @ model.projection()[:, kept]
            total += w.T @ w
            mean += w.sum(0)
        i, j = np.triu_indices(len(kept))
        columns = (np.append(i, np.arange(len(kept))), np.append(j, np.full(len(kept), -1)))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(np.append(total[i, j], mean))],
                                         ["i", "j", "s"])

    found = {(r.i, r.j): r.s / model.n for r in rows.select("x").mapInArrow(run, "i int, j int, s double")
             .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(s - found[i, -1] * found[j, -1] - (i == j)) for (i, j), s in found.items() if j >= 0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped; an empty
    vector is kept, and vectors shorter than the longest count as filled up with zeros.
    Repeated rows count and return each; rows without an id return with a null one. A
    component without variance (fewer distinct rows than dimensions, constant dimensions)
    is returned with 0 for ``whitened`` and is left out of ``identity_error``. An empty
    table gives none. Entries of 2**56 or more are refused. ``deviation`` is a decimal,
    exact up to 38 digits.
    """
    rows = integer_rows(vectors, id_col, vector_col)
    model = fit(rows, components, block_rows)
    error, dim, k = identity_error(rows, model), len(model.low), len(model.values)
    projection, explained = model.projection(), model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                centred, m = model.centred(_rows(part.column(1), dim)), part.num_rows
                deviation = pa.array(model.deviation(centred).tolist(), pa.decimal128(38, 0))
                w = (centred.astype(np.float64) / model.n) @ projection
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n)), deviation.take(at), pa.array(w.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                "explained double, identity_error double")
