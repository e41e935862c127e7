"""Mixing sources to target weights by Poisson replication.

A source of ``n`` documents that shall hold the share ``w`` of a mix of ``size``
documents repeats each of them ``w * size / n`` times on average. How often one
document occurs is the inverse of the Poisson distribution with that mean at a
number hashed from its id and the seed, so every executor, run and engine finds the
same count. Documents are exploded by their counts and shuffled globally: each copy
goes to the partition, and in it to the place, that a second hash gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import fresh, land, unit_hash

#: Exponent of the sources' natural shares where no weights are given: rare sources gain.
TEMPERATURE = 0.5
SEED = 42
#: Standard deviations of the distribution that are tabled; hashes are multiples of 2**-48, so none lies beyond.
DEVIATIONS = 12


def poisson_table(mean: float) -> np.ndarray:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, summed in log space."""
    if not mean > 0:
        return np.ones(1)
    k = np.arange(1, math.ceil(mean + DEVIATIONS * math.sqrt(mean) + 40) + 1)
    return np.cumsum(np.exp(np.cumsum(np.append(-mean, math.log(mean) - np.log(k)))))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [poisson_table(r) for r in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, pa.list_(pa.float64()))], ["source", "rate", "table"])


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None,
                 temperature: float = TEMPERATURE, size: float | None = None) -> DataFrame:
    """(source, n, rate) of every source, null being one of them.

    ``weights`` are the target shares; a source they do not name gets none and its
    documents do not occur. Without weights a source's share is its natural one to
    the power of ``temperature``. ``size`` is the number of documents of the mix, by
    default that of the input.
    """
    counts = land(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.count("*").cast("double").alias("n")), "mix-counts")
    if weights is None:
        weighted = counts.withColumn("weight", F.pow("n", F.lit(temperature)))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weighted = counts.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)))
    total = weighted.agg(F.sum("weight").alias("weights"), F.sum("n").alias("docs")).first()
    wanted = (total.docs or 0.0) if size is None else float(size)
    scale = wanted / total.weights if total.weights else 0.0
    return weighted.select("source", "n", (F.col("weight") * F.lit(scale) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict[str, float] | None = None,
        temperature: float = TEMPERATURE, size: float | None = None, seed: int = SEED,
        copy_col: str = "copy", key_col: str = "shuffle_key") -> DataFrame:
    """The mix: all columns of ``docs``, the copy's number from 1, and its place in the shuffle.

    The two are added as ``copy_col`` and ``key_col``, with as many underscores before
    them as it takes where ``docs`` has such columns. Rows with equal ids, null ones too, occur equally often. Texts are not looked at,
    so null, empty and long ones are kept as they are. An empty table stays empty.
    """
    copy_col, key_col, src, rate, table, n, draw = fresh(
        docs, copy_col, key_col, "mix_source", "mix_rate", "mix_table", "mix_n", "mix_draw")
    rates = source_rates(docs, source_col, weights, temperature, size).select("source", "rate")
    rates = land(rates.mapInArrow(_tables, "source string, rate double, table array<double>"), "mix-tables")
    rates = rates.toDF(src, rate, table)
    drawn = docs.withColumn(draw, unit_hash(F.col(id_col), seed=seed))
    joined = drawn.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(src)))
    counted = joined.withColumn(n, F.size(F.filter(table, lambda c: c <= F.col(draw)))).where(F.col(n) > 0)
    copies = counted.select(*[F.col(f"`{c}`") for c in docs.columns],
                            F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_col))
    keyed = copies.withColumn(key_col, unit_hash(F.col(id_col), F.col(copy_col), seed=seed + 1))
    return keyed.repartition(key_col).sortWithinPartitions(key_col)
