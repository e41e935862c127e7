"""The source audit against brute force on small tables."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logspark.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)


def slow_audit(rows, min_docs=10, top=10):
    rows = [(lang or "", source or "", slow_terms(text)) for _, text, lang, source, _ in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, w) for x, s, w in rows if x == lang]
        docs = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        counts = {s: Counter(t for x, w in own if x == s for t in w) for s, _ in own}
        whole, v = sum(counts.values(), Counter()), len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept]

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pairs = [(sum(map(f, p[s], p[o])), o) for o in counts if o != s]
            terms = [(f(a, b), t) for t, a, b in zip(kept, p[s], q, strict=True) if c[t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


ROWS = [
    *[(i, f"alpha {'beta ' * (i % 4)}Gamma{i % 3} naïve ÜBER x{i}x the-end", "en" if i % 5 else None, f"s{i % 7}", 1) for i in range(90)],
    *[(200 + i, "same words in all rows", "de", "", 1) for i in range(12)],
    (300, None, "de", "quiet", None), (301, "", "de", "quiet", 0), (302, "12 ; 34", "de", None, 0),
    (303, "seldom", "fr", "a", 1), (304, "words here", "fr", "b", 1), (305, "lonely " * 20, "it", "only", 1),
    (None, "alpha \x00beta\x7fgamma0 ﻿zero", "en", "s1", 1), (306, "long " * 3000 + "tail", "en", "s2", 1),
]


@pytest.mark.parametrize(("postings", "fan_in", "step"), [(divergence.POSTINGS, divergence.FAN_IN, divergence.STEP), (7, 2, 3)])
def test_the_audit_agrees_with_brute_force(spark, postings, fan_in, step):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(5).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    found = divergence.audit(docs, min_docs=3, postings=postings, fan_in=fan_in, step=step).collect()
    assert sorted(map(tuple, found)) == slow_audit(ROWS, 3)


def test_blocks_and_held_sums_may_be_small(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "HELD_SOURCES", 4)
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    found = divergence.audit(docs, min_docs=3, postings=50, fan_in=2, step=5).collect()
    assert sorted(map(tuple, found)) == slow_audit(ROWS, 3)


def test_an_empty_table_gives_none(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    lone = spark.createDataFrame([(1, "a b", "en", "s", 1), (2, "", "en", "t", 1)], DOCS)
    assert sorted(map(tuple, divergence.audit(lone).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    wordless = spark.createDataFrame([(1, "", None, None, 1)], DOCS)
    assert divergence.audit(wordless, min_docs=1).count() == 0


def test_terms_are_cut_whole():
    text = b"Ab\xc3\xa9c " * 100 + b"z" * 500 + b" tail"
    for size in (1, 7, 1 << 20):
        words = [w for piece in divergence.pieces(text, size) for w in piece]
        assert words == [b"ab\xc3\xa9c"] * 100 + [b"z" * 500, b"tail"]


@pytest.mark.parametrize("step", [1, 4, 1000])
def test_runs_merge_by_term(step):
    rng = random.Random(step)
    blocks, want = [], Counter()
    for _ in range(30):  # runs whose blocks follow each other
        terms = sorted({bytes([rng.randrange(97, 123), rng.randrange(97, 123)]) for _ in range(40)})
        sources = [b"xy"[i:i + 1] for i in (rng.randrange(2) for _ in terms)]
        want.update(zip(terms, sources, strict=True))
        for i in range(0, len(terms), 7):
            part = pa.RecordBatch.from_pydict({"term": terms[i:i + 7], "source": sources[i:i + 7], "n": [1] * len(terms[i:i + 7]),
                                               "df": [2] * len(terms[i:i + 7])})
            blocks.append(((0, b"en", 0), terms[i], part))
    blocks.sort(key=lambda b: b[1])
    found = [tuple(r.values()) for _, t in divergence.merge_blocks(iter(blocks), step) for r in t.to_pylist()]
    assert found == [(t, s, n, 2 * n) for (t, s), n in sorted(want.items())]
