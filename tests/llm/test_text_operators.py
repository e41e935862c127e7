"""SimHash, decontamination, quality, mixing, language and PII against brute force on small tables."""

import hashlib
import math
import re
import time

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from logspark.llm import decontaminate, langid, mixing, pii, quality, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = [(1, None, None, None, None), (2, "", "en", "s", 0)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def slow_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, max_bits):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_a_fingerprint_is_the_bitwise_majority():
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    for text in ("", None, "One", "a b", "A\tb\nC d", "x  y\x0bz w v", "Éa é É", long):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("node_rows", [simhash.NODE_ROWS, 4])
def test_links_span_the_components_that_all_pairs_give(spark, node_rows):
    rng = np.random.default_rng(3)
    prints = []
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        near = centre
        for _ in range(9):  # chains, so that components are wider than three bits
            for bit in rng.integers(0, 64, int(rng.integers(1, 4))).tolist():
                near ^= 1 << bit
            prints.append(near)
    prints = list(dict.fromkeys([*prints, 0, 1, (1 << 64) - 1]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, rep long")
    roots = {r.u: r.root for r in simhash.components(simhash.near_links(reps, 3, node_rows)).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == slow_components(prints, 3)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_handle_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(200))
    docs = docs_of(spark, [*EMPTY, (5, text, "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1),
                           (None, text, "en", "s", 1), (9, "other words entirely", "en", "s", 1)])
    docs = docs.withColumn("fp", F.lit("clash")).withColumn("kept_id", F.lit(0))
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(1, 1), (2, 1), (5, 3), (3, 3), (None, 3), (9, 9)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_contained_items_are_found_and_nothing_else(spark):
    item = " ".join(f"q{i}" for i in range(30))
    filler = " ".join(f"d{i}" for i in range(20_000))
    changed = item.replace("q29", "other")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "two Words")], "item_id long, text string")
    docs = docs_of(spark, [*EMPTY, (10, f"{filler} {item.upper()}\n{filler}", "", "", 0), (11, f"x {changed} y", "", "", 0),
                           (12, " ".join(item.split()[:20]), "", "", 0), (13, "two  words", "", "", 0), (14, filler, "", "", 0)])
    docs = docs.withColumn("item_id", F.lit("clash"))
    for block, chars in ((1, 1 << 20), (1000, 1 << 20), (1000, 30)):
        found = decontaminate.contaminated(docs, items, block_items=block, block_chars=chars)
        assert sorted(map(tuple, found.collect())) == [(10, 1, 26, 26), (11, 1, 25, 26), (13, 4, 1, 1)]
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 12, 14]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_the_sketch_of_an_item_is_longer_than_what_may_be_missing():
    for n in (1, 5, 9, 26, 60, 300):
        rows = [(0, " ".join(f"q{i}" for i in range(n + 4)))]
        partition, = decontaminate.sketch_items(rows, 5, 0.8).partitions
        assert len(partition.hashes) > 0.2 * n - 1e-9


def test_a_text_is_sketched_for_each_size_partition_apart():
    long = [(i, " ".join(f"q{i}x{j}" for j in range(1004))) for i in range(3)]
    sketches = decontaminate.sketch_items([*long, (9, "one two three four five")], 5, 0.8)
    small, large = sketches.partitions
    # Items of many shingles have sketches of their smallest hashes; the short item does not widen their bound.
    assert len(small.hashes) == 1 and large.hashes[-1] < 0.3 * 2**64
    text = " ".join(f"w{i}" for i in range(5000))
    for items, want in (([*long], 0), ([*long, (4, " ".join(text.split()[100:160]))], 1)):
        assert len(decontaminate.matches_in(text, decontaminate.sketch_items(items, 5, 0.8), 5, 0.8)) == want


def test_copies_follow_the_poisson_distribution(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
                                      F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("n_chars"))
    weights = {"a": 0.75, "b": 0.25}
    counts = {(r.source, r.n): r["count"] for r in mixing.mix(docs, weights=weights).groupBy("source", "doc_id").agg(
        F.count("*").alias("n")).groupBy("source", "n").count().collect()}
    for source, n in (("a", 6667), ("b", 13333)):
        rate = weights[source] * 20_000 / n
        for k in range(1, 6):
            p = math.exp(-rate) * rate**k / math.factorial(k)
            assert abs(counts.get((source, k), 0) / n - p) < 5 * math.sqrt(p / n)


def test_the_mix_handles_odd_rows(spark):
    docs = docs_of(spark, [*EMPTY, (2, "", "en", "s", 0), (None, "x", "en", "t", 1)]).withColumn("copy_", F.lit(1))
    out = mixing.mix(docs, size=400.0)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) == {1, 2, None} and counts[2] % 2 == 0  # the repeated row occurs equally often
    assert 300 < sum(counts.values()) < 500
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={}).count() == 0


def test_added_columns_do_not_clash(spark):
    docs = docs_of(spark, [(i, "t", "en", "s", 1) for i in range(30)]).withColumn("copy", F.lit("a")).withColumn("SHUFFLE_KEY", F.lit("b"))
    out = mixing.mix(docs, size=90.0)
    assert out.columns == [*docs.columns, "_copy", "_shuffle_key"]
    rows = out.collect()
    assert {(r.copy, r.SHUFFLE_KEY) for r in rows} == {("a", "b")} and {r["_copy"] for r in rows} >= {1, 2, 3}


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 7.5, 300.0, 20_000.0])
def test_the_poisson_table_agrees_with_its_definition(mean):
    table = mixing.poisson_table(mean)
    want = np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(len(table))]) if mean else [1.0]
    assert np.allclose(table, want, rtol=1e-9, atol=1e-12) and table[-1] > 1 - 1e-9


def test_quality_of_documents_whose_labels_were_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = quality.score_quality(docs, labels.where(~held), columns=["doc_id"]).select("doc_id", "keep")
    seen = scored.join(labels.where(held), "doc_id").groupBy("quality", "keep").count().collect()
    counts = {(r.quality, r.keep): r["count"] for r in seen}
    good, bad = ([counts.get((q, k), 0) for k in (True, False)] for q in (1, 0))
    assert sum(good) > 500 and sum(bad) > 80
    assert good[1] <= 0.005 * sum(good) and bad[0] <= 0.02 * sum(bad)


def test_a_repeated_word_counts_whatever_its_length(spark):
    df = spark.createDataFrame([("x" * n + " ") * 4 for n in (1, 64, 65, 5000)], "string").toDF("text")
    assert [round(r[0], 2) for r in df.select(quality.features(F.col("text"))["repeated"]).collect()] == [0.75] * 4


def slow_quality(rows, model, strength_bounds):
    """Scores of (evidence log odds, host, path), by the formulas."""
    chance = lambda x: 1 / (1 + math.exp(-x))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    p = [chance(e) for e, _, _ in rows]
    mean = sum(p) / len(p)
    by_host, by_path = {}, {}
    for x, (_, host, path) in zip(p, rows, strict=True):
        by_host.setdefault(host, []).append(x)
        by_path.setdefault((host, path), []).append(x)
    seen = np.mean([(np.mean(v) - mean) ** 2 for v in by_host.values()])
    noise = np.mean([sum(x * (1 - x) for x in v) / len(v) ** 2 for v in by_host.values()])
    low, high = strength_bounds
    strength = max(low, min(high, mean * (1 - mean) / (seen - noise) - 1)) if seen > noise else high
    host_mean = {h: (sum(v) + strength * mean) / (len(v) + strength) for h, v in by_host.items()}
    path_mean = {k: (sum(v) + strength * host_mean[k[0]]) / (len(v) + strength) for k, v in by_path.items()}
    return [chance(e + odds(path_mean[h, q]) - odds(mean)) for e, h, q in rows]


def test_scores_follow_the_formulas(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit_evidence(docs, labels)
    host, path = quality.site_columns(F.col("source"), F.col("lang"))
    rows = docs.select("doc_id", quality.evidence(F.col("text"), model).alias("e"), host.alias("h"), path.alias("p")).collect()
    want = slow_quality([(r.e, r.h, r.p) for r in rows], model, quality.STRENGTH)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    for r, score in zip(rows, want, strict=True):
        assert got[r.doc_id].quality_p == pytest.approx(score, abs=1e-9) and got[r.doc_id].keep == (score >= quality.THRESHOLD)


def test_quality_shrinks_sparse_sites_and_keeps_clean_documents(spark):
    good = "Some plain words in a sentence that reads well, and then another one."
    bad = "a | b | c | d | e | f | g | h | i | j"
    rows = [(i, f"{good} {i}" if i % 4 else f"{bad} {i}", "en", "big" if i % 5 else f"small{i}", 0) for i in range(400)]
    docs = docs_of(spark, [*rows, (1000, None, None, None, None), (1001, "", "en", "s/x", 0), (1, rows[1][1], "en", "big", 0)])
    docs = docs.withColumn("keep", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, labels)
    names = quality.added(docs)
    assert names[4] == "_keep" and scored.count() == docs.count()
    got = {r.doc_id: r for r in scored.collect()}
    assert all(got[i]["_keep"] == bool(i % 4) for i in range(400))
    overall = sum(r.evidence_p for r in got.values()) / len(got)
    small = [abs(got[i].host_mean - overall) for i in range(0, 400, 5)]
    assert max(small) < 0.6  # one document does not move its host to its own value
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = docs_of(spark, [(5000, None, "en", "s", 0), (5001, "123 .,!", "en", "s", 0), (5002, "the", None, None, 0)])
    docs = docs.unionByName(odd).withColumn("lang_pred", F.lit("clash"))
    held = queries.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    got = langid.predict(docs, model, "doc_id", "text", held.alias("held_out")).join(docs.select("doc_id", "lang"), "doc_id")
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[5000].lang_pred, rows[5000].score) == ("und", 0.0) == (rows[5001].lang_pred, rows[5001].score)
    out = [r for r in rows.values() if r.held_out and r.doc_id < 5000]
    assert sum(r.lang == r.lang_pred for r in out) > 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = langid.predict(docs.limit(3), langid.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def slow_grams(text):
    """Counts by hash of all one to three character runs of a text whose other characters are one gap each."""
    mix, mask = [int(m) for m in langid._MIX], (1 << 64) - 1
    codes = re.sub(f"[^{''.join(sorted({c for c in text.lower() if c.isalpha()}))}]+" if any(map(str.isalpha, text)) else "(?s).+",
                   " ", f" {text.lower()} ")
    counts = np.zeros(1 << langid.BITS, np.int64)
    for size in (1, 2, 3):
        for i in range(len(codes) - size + 1):
            if codes[i:i + size] != " ":
                h = sum(ord(c) * m for c, m in zip(codes[i:i + size], mix)) & mask
                h = (h ^ (h >> 29)) * mix[0] & mask
                counts[h >> (64 - langid.BITS)] += 1
    return counts


@pytest.mark.parametrize("piece", [1, 2, 3, 4, 7, 1 << 20])
def test_ngrams_of_a_text_are_those_of_its_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in ("abc déf " * 10, "1 2 3", "", " a", "A  b,, c1d", "x" * 20, "ÀÉ über", "a"):
        assert (langid.gram_counts(text) == slow_grams(text)).all()
    assert (langid.gram_counts("ABC") == langid.gram_counts("abc")).all()


def test_ngrams_of_very_long_texts_are_not_cut(monkeypatch):
    word = "abcdé "
    for size in range(langid.PIECE - 3, langid.PIECE + 4):
        text = (word * (size // 6 + 1))[:size]
        cut = langid.gram_counts(text)
        monkeypatch.setattr(langid, "PIECE", 1 << 22)
        assert (cut == langid.gram_counts(text)).all()
        monkeypatch.undo()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def slow_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "phone" and not 8 <= len(digits) <= 15
                    or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "no data", "a@b.c and x.y+z@d-e.fg.hi, a@b@c.d a@b.c_d@e.f @x.y a@b. %@1.2",
    "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 .1.2.3.4",
    "10.0.0.1 0.0.0.0 00.000.0.0 192.168.100.200 1.2.3.0255 1.2.3.300 1.0.0.2560 90.80.70.60 255.249.250.199", "é😀 4111 1111 1111 1111, 4111-1111-1111-1112; 5500005555555559",
    "+1 (017) 555-7713 97.51.17.173 +49 30 1234567; +12 +1234567 +1 (017) 555-7713 4111111111111111",
    "mail bob (at) example (dot) org, call: 555-123-4567 +1 (974) 555-3436.", "4111 1111 1111 1111" * 3,
]


def test_base_findings_are_those_of_the_rules(spark):
    docs = docs_of(spark, [(i, t, "", "", len(t or "")) for i, t in enumerate(TEXTS)]).withColumn("pii_text", F.lit("clash"))
    trees = pii.fit_trees(docs)
    for r in pii.find_spans(docs, trees).collect():
        want = slow_base(TEXTS[r.doc_id])
        assert [f"{k}:{s['at']}:{s['end']}" for k in pii.KINDS for s in r[f"sure_{k}"]] == want
        every = {f"{k}:{s['at']}:{s['end']}" for k in pii.KINDS for s in r[f"all_{k}"]}
        assert set(want) <= every
    assert pii.fit_trees(docs.limit(0)) == pii.Trees() and pii.find_spans(docs.limit(0), trees).count() == 0


def test_findings_are_masked_and_the_rest_is_kept(spark):
    docs = docs_of(spark, [(i, t, "", "", None) for i, t in enumerate(TEXTS)]).withColumn("pii_m0", F.lit("clash"))
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[0].text is None and got[1].text == "" and got[2].text == "no data"
    assert got[6].text == "é😀 [CARD], 4111-1111-1111-1112; [CARD]" and got[6].n_chars == len(got[6].text)
    assert pii.redact(docs).columns == docs.columns
    for r in got.values():
        assert not [s for s in slow_base(r.text) if s.startswith(("email", "ip"))]


def test_trees_are_learnt_and_add_what_the_base_rules_miss(spark):
    runs = [f"+1 (0{i:02d}) 555-77{i:02d} 97.51.17.{i}" for i in range(60)]  # the run is too long for the base rule
    plain = [f"+1 (9{i:02d}) 555-34{i:02d} and 4111 1111 1111 {1111 + i}" for i in range(200)]
    docs = docs_of(spark, [(i, t, "", "", 0) for i, t in enumerate(runs + plain)])
    trees = pii.fit_trees(docs)
    assert trees.trees and trees.threshold("phone") <= 1
    first = pii.find_spans(docs.where("doc_id = 0"), trees).first()
    assert not first.sure_phone and [(s["at"], s["end"]) for s in first.all_phone] == [(0, 17)]


def slow_features(g, match, before, after):
    digits = re.sub("[^0-9]", "", match)
    near = before[-pii.CONTEXT:]
    valid = {"email": True, "ip": g.kind == "ip" and max(map(int, match.split("."))) <= 255,
             "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[g.kind]
    has = lambda pattern, t: bool(regex.search(pattern, t, regex.ASCII))
    return [pii.GENERATORS.index(g), min(len(digits), 24), min(len(re.sub(r"[^ .-]", "", match)), 8), has(r"[()\[\]{}]", match),
            valid, has(pii.CUES[g.kind], near), has(r"[\p{L}0-9_/=#]$", near) or has(r"^[\p{L}0-9_/=]", after[:1]),
            has(r"[$€£] ?$", near), math.floor(4 * len(re.sub("[^A-Z]", "", match)) / len(match) + 0.5)]


def slow_chance(trees, f):
    def at(node):
        while isinstance(node, tuple):
            node = node[2] if f[node[0]] <= node[1] else node[3]
        return node
    return 1 / (1 + math.exp(-2 * sum(w * at(t) for w, t in trees.trees)))


def slow_spans(text, trees):
    """All spans of a text: base ones, and further ones that the trees accept and no base span of their kind holds."""
    text, out = text or "", []
    base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in slow_base(text))]
    for kind in pii.KINDS:
        sure = [(a, b) for k, a, b in base if k == kind]
        more = set()
        for g in pii.GENERATORS:
            if g.kind == kind and trees.adds(g):
                end = 0
                matches = list(regex.finditer(g.pattern, text, regex.ASCII))
                for i, m in enumerate(matches):
                    after = text[m.end():matches[i + 1].start() if i + 1 < len(matches) else None]
                    if slow_chance(trees, slow_features(g, m.group(), text[end:m.start()], after)) >= trees.threshold(kind):
                        more.add(m.span())
                    end = m.end()
        out += [(kind, *s) for s in sorted([*sure, *(s for s in more if not any(a <= s[0] and s[1] <= b for a, b in sure))])]
    return out


@pytest.mark.parametrize("chunk", [2, pii.CHUNK])
def test_all_spans_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(pii, "CHUNK", chunk)
    made = [f"tel 555-12{i:02d}-34{i:02d}, call: 555-321-{1000 + i}; card 4111 1111 1111 1111{i} bob{i} (at) ex{i} (dot) org $1.2.3.{i}"
            for i in range(20)]
    made += [f"+1 (0{i:02d}) 555-77{i:02d} 97.51.17.{i} phone (555) 123-{4000 + i} mail: a.b{i} [at] c.de a@b.cd 1.2.3.4.5" for i in range(60)]
    texts = [*TEXTS, *made, " ; ".join(made)]
    docs = docs_of(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])
    grown = pii.fit_trees(docs)
    assert grown.trees
    for trees in (grown, pii.Trees(grown.trees, (0.3,) * 4), pii.Trees(grown.trees, (0.0,) * 4)):
        for r in pii.find_spans(docs, trees).collect():
            got = [(k, s["at"], s["end"]) for k in pii.KINDS for s in r[f"all_{k}"]]
            assert got == slow_spans(texts[r.doc_id], trees)


def test_the_time_for_a_text_grows_with_its_findings(spark):
    def seconds(n):
        text = " ".join(f"user{i}@example.com 1.2.3.{i % 256} 555-123-{i % 9000 + 1000}" for i in range(n))
        docs = docs_of(spark, [(1, text, "", "", 0)])
        start = time.time()
        row = pii.find_spans(docs, trees).select(*[F.size(f"all_{k}") for k in pii.KINDS]).first()
        assert tuple(row) == (n, n, 0, n)
        return time.time() - start

    trees = pii.Trees(((1.0, 1.0),), (0.5,) * 4)
    seconds(100)
    few, many = seconds(2000), seconds(32_000)
    assert many < 16 * max(few, 0.5) and many < 20


def test_the_base_digests_are_those_of_the_rules_over_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for row in queries.op3_pii(spark, "/root/testdata/sf0.001").collect():
        want = slow_base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
