"""Language identification by sparse multinomial logistic regression.

Character n-grams of one to three letters are hashed into ``1 << BITS`` features and
weighted by TF-IDF; the document frequencies are counted over all training
documents. The weights are learnt with follow-the-regularised-leader, whose L1
penalty leaves most of them zero and whose L2 penalty bounds the rest, on a bounded
sample of every language; a part of the sample is held back to fit the temperature
that turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.shared import land

BITS = 14
#: Documents of each language that the weights are learnt on, those with the smallest hashes of their ids.
PER_LANGUAGE = 400
#: Every so manieth of them fits the temperature instead.
CALIBRATE = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SEED = 42
#: Characters looked at together.
PIECE = 1 << 20
UNKNOWN = "und"
#: What marks the gap between words in an n-gram, and the factors that mix its characters.
_GAP = 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_counts(text: str | None) -> np.ndarray:
    """How often each hashed n-gram occurs in a text; all zero where it has no letter.

    A text is looked at piece by piece, with its last two characters in hand, so the
    counts are those of the whole.
    """
    counts = np.zeros(1 << BITS, np.int64)
    text, shift = (text or "").lower(), np.uint64(64 - BITS)
    held = np.array([_GAP], np.uint64)
    for at in range(0, len(text) + 1, PIECE):
        codes = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(_letters()[codes], codes, _GAP).astype(np.uint64)
        last = [_GAP] if at + PIECE > len(text) else []
        codes = np.concatenate((held, codes, np.array(last, np.uint64)))
        codes = codes[np.concatenate(([True], (codes[1:] != _GAP) | (codes[:-1] != _GAP)))]
        one = codes * _MIX[0]
        two = one[:-1] + codes[1:] * _MIX[1]
        three = two[:-1] + codes[2:] * _MIX[2]
        new = len(held)
        for grams in (one[new:][codes[new:] != _GAP], two[new - 1:], three):
            mixed = (grams ^ (grams >> np.uint64(29))) * _MIX[0]
            counts += np.bincount((mixed >> shift).astype(np.int64), minlength=1 << BITS)
        held = codes[-2:]
    return counts


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF of a count vector."""
    x = np.log1p(counts) * idf
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def chances(self, counts: np.ndarray) -> np.ndarray:
        return softmax((_weigh(counts, self.idf) @ self.weights + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over (indices, values, class), with elastic-net penalties."""
    size = (1 << BITS) + 1  # the last feature is the bias
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def solved(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            own_z, own_n = z[at], n[at]
            w = solved(own_z, own_n)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            step = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / ALPHA
            z[at], n[at] = own_z + g - step * w, own_n + g * g
    w = solved(z, n)
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which held-back classes are likeliest."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """A model of all rows with a language and a text; without any it knows no language."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += gram_counts(text.as_py()) > 0
                total += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.append(total, seen))], ["f", "n"])

    found = rows.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    df = np.zeros((1 << BITS) + 1)
    for f, n in ((r.f, r.n) for r in found.collect()):  # one row a feature
        df[f + 1] = n
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1

    h = F.xxhash64("id", F.lit(SEED))
    part = W.partitionBy("lang", "salt").orderBy("h", "id")
    ranked = (rows.select("id", "lang", h.alias("h"), F.pmod(h, F.lit(64)).alias("salt"))
              .withColumn("r", F.row_number().over(part)).where(F.col("r") <= per_language)
              .withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= per_language))
    chosen = land(ranked.select(F.col("id").alias("chosen_id"), F.col("lang").alias("chosen_lang")), "langid-sample")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                counts = gram_counts(text.as_py())
                at = np.flatnonzero(counts)
                out.append((at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1))],
                ["id", "lang", "at", "n"])

    # The sample holds at most per_language rows of a language, hence the broadcast and the collect.
    sample = rows.join(F.broadcast(chosen), (F.col("id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")), "left_semi")
    got = sorted((r.lang, r.id, r["at"], r.n) for r in sample.select("id", "text", "lang").mapInArrow(
        packed, "id string, lang string, at binary, n binary").collect())
    languages = sorted({g[0] for g in got})
    rows_, held = [], []
    for i, (lang, _, at, n) in enumerate(got):
        at = np.frombuffer(at, "<u2").astype(np.int64)
        x = np.log1p(np.frombuffer(n, "<u4")) * idf[at]
        norm = np.sqrt(x @ x)
        if norm:
            (held if i % CALIBRATE == 0 else rows_).append((at, x / norm, languages.index(lang)))
    if not rows_:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    weights, bias = follow_the_leader(rows_, len(languages))
    scores = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(scores, np.array([y for _, _, y in held], int)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """(doc_id, extra columns, lang_pred, score) of every row.

    A null text, one without a letter, and any text where the model knows no language
    are ``und`` with score 0. Texts are read whole; repeated rows stay. Equal scores go
    to the first language in alphabetical order.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).cast("string").alias("text"))
    kept = rows.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                counts = gram_counts(text.as_py())
                p = model.chances(counts) if model.languages and counts.any() else None
                langs.append(UNKNOWN if p is None else model.languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
