"""How the sources of a language differ in their words: single-pass in-memory indexing.

Every task indexes its documents into block postings, (language, term, source) with
occurrences and documents, until ``postings`` of them are held; then the block is
spilled as a run, sorted by term and cut into hash shards, and the next one begins.
The runs of a shard are heap-merged in one stream over their blocks, which arrive by
their first term, so a task holds one block of each run at most. More than ``fan_in``
runs are first merged into fewer in rounds, so that holds for any amount of text, and a
term in every document arrives as one posting per run and source.

The divergence of two sources sums ``f(p, q) = (p - q)^2 / (p + q)`` in whole numbers
over all kept terms, most of which neither has. Start from all terms being absent in
both, which is one product; correct it for the terms that one has, by how many of its
terms occur how often; and stream over the terms, correcting for each pair of sources
that has it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.shared import land

MIN_DOCS, TOP_TERMS = 10, 10
#: Postings that a task holds before it spills a run.
POSTINGS = 300_000
#: Postings of one block of a run, postings merged at a time, and runs that are merged together.
BLOCK, STEP, FAN_IN = 2048, 1 << 17, 64
#: Bytes of a text that are cut into terms at a time.
SLICE = 1 << 20
#: Sources whose pair sums a task holds before it hands them on.
HELD_SOURCES = 1024
#: Letters in lower case, everything else below 0x80 a space: bytes of 0x80 and above belong to terms.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BLOCKS = ("shard int, lang binary, run long, first binary, terms array<binary>, sources array<binary>, "
           "ns array<long>, dfs array<long>")
_LISTS = ["term", "source", "n", "df"]


def pieces(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a whole text, some bytes of it at a time; a term is never cut."""
    text = text.translate(_TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + size)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _edges(codes: np.ndarray) -> np.ndarray:
    """Where each stretch of equal codes begins."""
    return np.append(0, np.flatnonzero(np.diff(codes)) + 1) if len(codes) else np.zeros(0, np.int64)


def _listed(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _cut(postings: pa.Table, edges: np.ndarray, sections: list[tuple], run: int) -> pa.RecordBatch:
    """Sorted postings as blocks; the sections (shard, lang) begin at ``edges``."""
    columns = [postings[c].combine_chunks() for c in _LISTS]
    stretches = [np.arange(a, b, BLOCK) for a, b in zip(edges, np.append(edges[1:], len(postings)), strict=True)]
    starts = np.concatenate(stretches)
    shards, langs = zip(*(x for x, part in zip(sections, stretches, strict=True) for _ in part), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array(langs, pa.binary()), pa.array(np.full(len(starts), run)),
         columns[0].take(pa.array(starts)), *(_listed(starts, c) for c in columns)],
        ["shard", "lang", "run", "first", "terms", "sources", "ns", "dfs"])


def _run(occurs: dict, within: dict, shards: int, number: int) -> pa.RecordBatch:
    """The block postings of a task, sorted by shard, language, term and source."""
    names = sorted({lang for lang, _ in occurs})
    terms, sources, sizes, langs, ns, dfs = [], [], [], [], [], []
    for (lang, source), counts in occurs.items():
        terms += counts
        ns += counts.values()
        dfs += map(within[lang, source].__getitem__, counts)
        sources.append(source)
        langs.append(names.index(lang))
        sizes.append(len(counts))
    of = np.repeat(np.arange(len(sizes)), sizes)
    langs = np.array(langs, np.int64)[of]
    spread = np.fromiter(map(crc32, terms), np.int64, len(terms)) ^ np.array([crc32(x) for x in names], np.int64)[langs]
    table = pa.table({
        "section": spread % shards * len(names) + langs, "term": pa.array(terms, pa.binary()),
        "source": pa.array(sources, pa.binary()).take(pa.array(of)), "n": pa.array(ns, pa.int64()), "df": pa.array(dfs, pa.int64())})
    table = table.sort_by([(c, "ascending") for c in ("section", "term", "source")])
    section = table["section"].to_numpy()
    edges = _edges(section)
    return _cut(table, edges, [(x // len(names), names[x % len(names)]) for x in section[edges].tolist()], number)


def _index(most: int, shards: int):
    """Documents (lang, source, text) to runs of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, occurs, within = TaskContext.get().partitionId() << 24, 0, {}, {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, own = occurs.setdefault((lang, source), Counter()), set()
                before = len(counts)
                for words in pieces(text):
                    counts.update(words)
                    own.update(words)
                within.setdefault((lang, source), Counter()).update(own)
                held += len(counts) - before
                if held >= most:
                    yield _run(occurs, within, shards, number)
                    number, held, occurs, within = number + 1, 0, {}, {}
        if held:
            yield _run(occurs, within, shards, number)

    return run


def merge_blocks(blocks: Iterator[tuple], step: int = STEP) -> Iterator[tuple]:
    """(section, postings) with equal postings summed, by term, from blocks (section, first term, postings).

    Blocks come by section and first term and wait in a heap by their next term. When a
    block is opened, all terms before its first one are complete; once ``step`` postings
    wait, these are taken off the blocks, which return to the heap with their rest.
    """
    heap, waiting, section, opened = [], 0, None, 0

    def complete(before: bytes | None) -> pa.Table:
        parts = []
        while heap and (before is None or heap[0][0] < before):
            _, order, at, block = heapq.heappop(heap)
            terms = block["term"]
            end = len(terms) if before is None else bisect_left(terms, before, at, key=lambda x: x.as_py())
            parts.append(block.slice(at, end - at))
            if end < len(terms):
                heapq.heappush(heap, (terms[end].as_py(), order, end, block))
        summed = pa.Table.from_batches(parts).group_by(["term", "source"], use_threads=False).aggregate(
            [("n", "sum"), ("df", "sum")]).select(["term", "source", "n_sum", "df_sum"]).rename_columns(_LISTS)
        return summed.sort_by([("term", "ascending"), ("source", "ascending")])

    for of, first, block in blocks:
        if heap and of != section:
            yield section, complete(None)
            waiting = 0
        elif waiting >= step and heap[0][0] < first:
            yield section, complete(first)
            waiting = sum(len(b) - at for _, _, at, b in heap)
        section, opened, waiting = of, opened + 1, waiting + len(block)
        heapq.heappush(heap, (first, opened, 0, block))
    if heap:
        yield section, complete(None)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard, lang, run, first = (batch.column(c)[i].as_py() for c in range(4))
            yield (shard, lang, run), first, pa.RecordBatch.from_arrays([batch.column(c)[i].values for c in range(4, 8)], _LISTS)


def _merge_runs(step: int):
    """Blocks to blocks of one run for every group of runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, lang, group), postings in merge_blocks(_opened(batches), step):
            yield _cut(postings, np.zeros(1, np.int64), [(shard, lang)], group)

    return run


def _merge_frequencies(min_docs: int, step: int):
    """Blocks to (lang, term, sources, ns) of the terms in enough documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang, _), postings in merge_blocks(_opened(batches), step):
            term, source, n, df = (postings[c].combine_chunks() for c in _LISTS)
            starts = _edges(term.dictionary_encode().indices.to_numpy())
            kept = np.add.reduceat(df.to_numpy(), starts) >= min_docs
            rows = pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(starts), pa.binary()), term.take(pa.array(starts)), _listed(starts, source),
                 _listed(starts, n)], ["lang", "term", "sources", "ns"])
            yield rows.filter(pa.array(kept))

    return run


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, postings: int = POSTINGS, fan_in: int = FAN_IN,
                step: int = STEP) -> DataFrame:
    """(lang, term, sources, ns) of every term in ``min_docs`` documents of a language, from (lang, source, text)."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = land(docs.select("lang", "source", "text").mapInArrow(_index(postings, shards), _BLOCKS), "divergence-runs")
    runs = blocks.select("run").distinct().count()

    def gathered(group: Column) -> DataFrame:
        rows = blocks.select("shard", "lang", group.cast("long").alias("run"), "first", "terms", "sources", "ns", "dfs")
        return rows.repartition(shards, "shard", "run").sortWithinPartitions("shard", "lang", "run", "first")

    while runs > fan_in:
        runs = -(-runs // fan_in)
        groups = F.pmod(F.xxhash64("run"), F.lit(runs))
        blocks = land(gathered(groups).mapInArrow(_merge_runs(step), _BLOCKS), "divergence-merged")
    return gathered(F.lit(0)).mapInArrow(
        _merge_frequencies(min_docs, step), "lang binary, term binary, sources array<binary>, ns array<long>")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms))."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) "
                  f"div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _both_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, s) for a < b: corrections over the terms (lang, postings) that both sources have."""
    kinds = {"lang": pa.binary(), "a": pa.binary(), "b": pa.binary(), "s": pa.int64()}

    def distance(p, q):
        return (p - q) ** 2 // (p + q)

    def correction(p, p0, q, q0):
        p, p0, q, q0 = p[:, None], p0[:, None], q[None, :], q0[None, :]
        return distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)

    index: dict = {}
    sums = np.zeros((HELD_SOURCES, HELD_SOURCES), np.int64)

    def summed() -> pa.RecordBatch:
        names, (i, j) = list(index), np.nonzero(sums)
        columns = ([names[x][0] for x in i.tolist()], [names[x][1] for x in i.tolist()], [names[x][1] for x in j.tolist()], sums[i, j])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        flat = batch.column(1).flatten()
        names, p, p0 = flat.field(0).to_pylist(), np.asarray(flat.field(1)), np.asarray(flat.field(2))
        offsets = (np.asarray(batch.column(1).offsets) - batch.column(1).offsets[0].as_py()).tolist()
        for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
            step = HELD_SOURCES // 2
            tiles = [slice(i, min(b, i + step)) for i in range(a, b, step)]
            for k, one in enumerate(tiles):
                for other in tiles[k:]:
                    keys = {(lang, x) for x in names[one]} | {(lang, x) for x in names[other]}
                    if len(index) + len(keys - index.keys()) > HELD_SOURCES:
                        yield summed()
                        index.clear()
                        sums[:] = 0
                    for x in keys:
                        index.setdefault(x, len(index))
                    at, to = ([index[lang, x] for x in names[t]] for t in (one, other))
                    found = correction(p[one], p0[one], p[other], p0[other])
                    sums[np.ix_(at, to)] += np.triu(found, 1) if one == other else found
    yield summed()


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, postings: int = POSTINGS, fan_in: int = FAN_IN,
          step: int = STEP) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language.

    Part ``pair``: the divergence of every other source, largest first. Part ``term``:
    the terms that the source has more of than its language. Terms are runs of letters
    A-Z, in lower case, and of characters from U+0080; only those in ``min_docs``
    documents of a language count, and a language without any has divergences of 0.
    Null texts, languages and sources count as empty ones, which are texts, languages
    and sources like any other; repeated rows count each; ties go to the smaller item
    by its UTF-8 bytes. An empty table gives none, and a language's only source no pair.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = land(frequencies(rows, min_docs, postings, fan_in, step), "divergence-terms")
    in_lang = kept.select("lang", F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    flat = kept.select("lang", "term", F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n).alias("lang_n"),
                       F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))))
    in_source = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # One row a source and language; its written size lets Spark decide how it is joined.
    groups = land(
        rows.groupBy("lang", "source").agg(F.count("*").alias("docs")).drop("docs")
        .join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")])
        .withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "greatest(terms, 1)"))), "divergence-groups")
    found = flat.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0", _share("n", "total", "terms").alias("p"),
        _share("lang_n", "lang_total", "terms").alias("q"))

    by_value = (F.desc("value"), "item")
    more = found.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))
    terms = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).where(
        F.col("rank") <= top_terms)

    one = groups.select("lang", F.col("source").alias("a"), "terms", F.col("p0").alias("a0"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    absent = one.join(other, "lang").where("a <> b").select(
        "lang", "a", "b", F.coalesce(F.col("terms") * _distance("a0", "b0"), F.lit(0).cast("long")).alias("s"))
    often = found.groupBy("lang", F.col("source").alias("a"), "n", "p", F.col("p0").alias("a0")).agg(F.count("*").alias("times"))
    one_has = often.join(other, "lang").where("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("times") * (_distance("p", "b0") - _distance("a0", "b0"))).alias("s"))
    both = found.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("postings"))
    both_have = both.where(F.size("postings") > 1).select("lang", "postings").mapInArrow(
        _both_have, "lang binary, a binary, b binary, s long")
    either_way = F.array(F.struct("a", "b", "s"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    corrections = one_has.unionByName(both_have).select("lang", F.inline(either_way))
    pairs = absent.unionByName(corrections).groupBy("lang", "a", "b").agg(F.sum("s").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "part",
                      F.col("item").cast("string").alias("item"), "value", "rank")
