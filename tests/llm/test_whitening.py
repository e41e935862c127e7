"""Whitening against integer brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def slow(vectors):
    """n, exact deviations, covariance of the integers, all in Python integers."""
    xs = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(xs), len(xs[0])
    s = [sum(x[d] for x in xs) for d in range(dim)]
    deviations = [sum((n * x[d] - s[d]) ** 2 for d in range(dim)) for x in xs]
    cov = np.array([[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs) / n**3 for j in range(dim)] for i in range(dim)])
    return n, s, deviations, cov


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-500, 500, (300, 3)), rng.integers(-(1 << 45), 1 << 45, (300, 2)), np.full((300, 1), 7)], 1)
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, x array<long>").repartition(3)
    n, low, high = whitening.extents(rows)
    assert (n, low, high) == (300, x.min(0).tolist(), x.max(0).tolist())
    for block in (64, 77, 1 << 16):
        sums, products = whitening.scatter(rows, low, high, block)
        y = [[v - a for v, a in zip(r, low, strict=True)] for r in x.tolist()]
        assert sums == [sum(r[d] for r in y) for d in range(6)]
        assert {k: v for k, v in products.items() if v} == {
            (i, j): t for i in range(6) for j in range(i, 6) if (t := sum(r[i] * r[j] for r in y))}


def test_whitened_rows_agree_with_brute_force(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(0, 0.4, (200, 6)) @ rng.normal(0, 1, (6, 6))).astype(np.float32).tolist()
    v += v[:3]
    vectors = spark.createDataFrame([*((i, r, 0) for i, r in enumerate(v)), (900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
                                     (902, [float("nan")] * 6, 1), (903, [float("inf")] * 6, 1)], VECTORS).repartition(4)
    n, s, deviations, cov = slow(v)
    out = whitening.whiten(vectors.withColumn("n", F.lit("clash")).withColumn("x", F.lit("clash"))).toPandas()
    assert len(out) == n * 6 and set(out.vec_id) == set(range(n)) and set(out.n) == {n}
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for vec_id, part in out.groupby("vec_id"):
        part = part.sort_values("component")
        assert part.component.tolist() == [1, 2, 3, 4, 5, 6] and set(part.deviation.map(int)) == {deviations[vec_id]}
        assert np.allclose(part.explained, values / np.trace(cov), rtol=1e-9)
        x = np.floor(64 * np.array(v[vec_id], np.float64)) + 1_000_000 - np.array(s) / n
        # the squared length of the whitened row is its Mahalanobis distance, whatever the signs
        assert np.isclose((part.whitened**2).sum(), x @ np.linalg.solve(cov, x), rtol=1e-8)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / n, np.eye(6), atol=1e-9)


def test_odd_vectors(spark):
    def table(rows):
        return spark.createDataFrame(rows, VECTORS)

    assert whitening.whiten(table([]).limit(0)).count() == 0
    assert whitening.whiten(table([(1, None, 0)])).count() == 0
    same = whitening.whiten(table([(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (None, [0.5, 0.25], 0)])).collect()
    assert len(same) == 6 and all((r.whitened, r.explained, r.identity_error, int(r.deviation)) == (0, 0, 0, 0) for r in same)
    assert sum(r.vec_id is None for r in same) == 2
    ragged = whitening.whiten(table([(1, [0.5], 0), (2, [0.5, 0.25], 0), (3, [], 0)])).collect()
    _, _, deviations, _ = slow([[0.5, 0.0], [0.5, 0.25], [0.0, 0.0]])
    assert {(r.vec_id, int(r.deviation)) for r in ragged} == set(zip([1, 2, 3], deviations, strict=True))
    big = whitening.whiten(table([(1, [2.0**50, 0.0], 0), (2, [0.0, 1.0], 0)])).collect()
    assert {int(r.deviation) for r in big} == {(1 << 112) + 64 * 64}
    with pytest.raises(Exception, match="64-bit"):
        whitening.whiten(table([(1, [3e30, 1.0], 0)]))


def test_the_query_returns_every_row(spark):
    from logspark.llm import queries

    out = queries.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert dict(queries.op11_whitening(spark, "/root/testdata/sf0.001").dtypes)["deviation"] == "bigint"
    assert len(out) == 500 * 32 and out.identity_error[0] < 1e-6
