"""Prefix hashes and document fingerprints against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logspark.llm import fingerprints as fp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", "a", "aaaaaa", "abcabcabcabd", "naïve ünïcode 🙂 text " * 9, "x" * 300, "ab" * 200 + "c", "\x00\x00a"]


@pytest.mark.parametrize("chunk", [3, fp.CHUNK])
def test_spans_and_extensions_agree_with_the_texts(monkeypatch, chunk):
    monkeypatch.setattr(fp, "CHUNK", chunk)
    rng = random.Random(5)
    arrays = [fp.Prefixes.of(t) for t in TEXTS]
    for _ in range(3000):
        i, j = rng.randrange(len(TEXTS)), rng.randrange(len(TEXTS))
        s, t = TEXTS[i], TEXTS[j]
        a, b = rng.randint(0, len(s)), rng.randint(0, len(t))
        size = rng.randint(0, min(len(s) - a, len(t) - b))
        assert arrays[i].same(a, arrays[j], b, size) == (s[a:a + size] == t[b:b + size])
        common = next((k for k, (x, y) in enumerate(zip(s[a:], t[b:])) if x != y), min(len(s) - a, len(t) - b))
        assert arrays[i].extension(a, arrays[j], b) == common


def test_joined_prefixes_are_those_of_the_joined_text():
    for s in TEXTS:
        for t in TEXTS:
            cut, size = len(s) * 2 // 3, len(t) // 2
            joined = fp.Prefixes.of(s).joined(cut, fp.Prefixes.of(t), size)
            assert fp.fingerprint(joined) == fp.fingerprint(fp.Prefixes.of(s[:cut] + t[:size]))


def slow_likeness(s, t):
    """The same from the texts: beginnings and ends in multiples of the larger step."""
    if s == t:
        return 1.0
    step = max(fp._step(len(s)), fp._step(len(t)))
    most, shared = min(len(s), len(t)), 0
    for a, b in ((s, t), (s[::-1], t[::-1])):
        shared += next((k for k in range(most // step) if a[:(k + 1) * step] != b[:(k + 1) * step]), most // step) * step
    return min(shared, most) / max(len(s), len(t))


def test_likeness_agrees_with_the_texts():
    rng = random.Random(6)
    base = "".join(rng.choice("abcde ") for _ in range(5000))
    texts = [*TEXTS, base, base[:3000], base[1:], base[:2500] + "!" + base[2500:], base[:4000] + "other" * 200, "z" + base[1:-1] + "z"]
    marks = [fp.fingerprint(fp.Prefixes.of(t)) for t in texts]
    assert len(set(marks)) == len(texts)
    for s, m in zip(texts, marks, strict=True):
        for t, n in zip(texts, marks, strict=True):
            assert fp.likeness(m, n) == fp.likeness(n, m) == pytest.approx(slow_likeness(s, t))
    assert fp.likeness(marks[8], marks[11]) > 0.97 and fp.likeness(marks[8], marks[9]) == pytest.approx(0.6, abs=0.03)
    assert all(len(m) < 600 for m in marks)


def slow_rows(rows):
    def tie(text):
        return fp_ties[text or ""]

    fp_ties = {}

    def expect(ties):
        fp_ties.update(ties)
        order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), tie(r[1])))
        out = []
        for i, row in enumerate(order):
            text, following = row[1] or "", order[(i + 1) % len(order)][1] or ""
            cut = len(text) // 3
            edited = text[:len(text) - cut] + following[:cut]
            marks = [fp.fingerprint(fp.Prefixes.of(t)) for t in (text, edited, following)]
            out.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
                        fp.likeness(marks[0], marks[1]), fp.likeness(marks[0], marks[2])))
        return sorted(out, key=str)
    return expect


@pytest.mark.parametrize("size", [1, 2, 60])
def test_every_row_meets_its_successor(spark, size):
    rng = random.Random(size)
    rows = [(i * 7 - 50, " ".join(rng.choice(["alpha", "beta", "γ", "🙂"]) for _ in range(rng.randrange(80))), "", "", 0)
            for i in range(size)]
    if size > 2:
        rows += [(3000, None, None, None, None), (3001, "", "", "", 0), (None, "lost", "", "", 0), (None, "lost", "", "", 0),
                 (None, "other lost", "", "", 0), (20, "twice", "", "", 0), (20, "twice", "", "", 0)]
        rows += [(77, f"one id for {i}", "", "", 0) for i in range(40)]  # a hot id spreads over ranges
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumn("at", F.lit("clash")).withColumn("id", F.lit(1))
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    ties = {r.t: r.h for r in hashed.collect()}
    found = sorted(map(tuple, fp.fingerprints(docs).collect()), key=str)
    assert found == slow_rows(rows)(ties)


def test_an_empty_table_gives_none(spark):
    assert fp.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_a_very_long_text(spark):
    long = "lorem ipsum ü " * 150_000
    found = fp.fingerprints(spark.createDataFrame([(2, long, "", "", 0), (1, "short", "", "", 0)], DOCS)).orderBy("doc_id").collect()
    assert found[1].n_chars == len(long) and found[1].near_edited == pytest.approx(2 / 3, abs=0.02)
    assert found[0].edited_sha256 == hashlib.sha256(b"shorl").hexdigest()
