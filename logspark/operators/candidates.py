"""Exact top keys without shuffling all keys: sketches name candidates, a second pass counts them.

The first pass keeps one sketch of bounded size per task and tally; only those are
exchanged. A sketch over ``N`` entries misstates a count by no more than a fixed share
of ``N``, and names every key that occurs more than twice as often. So the merged sketch
gives a count that the ``k``-th key reaches at least, and, where that is beyond what can
go unnamed, all keys that can be among the ``k`` first. The second pass
counts these alone, by a broadcast of their hashes: at most ``tracked`` numbers of 64
bits a tally, whatever the data. Where the share is too large to prove that no other
key belongs, all keys of that tally are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.tallies import FEW_KEYS, TALLIES, tally_counts, tally_entries, top_keys
from logspark.plans.once import landed_at

#: Items that a sketch tracks, and keys of a tally that may be candidates.
TRACKED = 10_000
MANY_KEYS = tuple(t for t in TALLIES if t not in FEW_KEYS)


def sketch_error(total: Column, tracked: int) -> Column:
    """By how much the count of a key can be off; an unnamed key occurs at most twice that often.

    The guarantee of the frequent-items sketch is 3.5 entries in as many as it has
    slots, and it has the next power of two of a third more slots than tracked items.
    """
    slots = 1 << (-(-tracked * 4 // 3) - 1).bit_length()
    return F.floor(total * F.lit(3.5) / F.lit(slots))


def candidate_keys(rows: DataFrame, k: int, tracked: int = TRACKED, tallies: tuple[str, ...] = MANY_KEYS) -> DataFrame:
    """``(tally, proven, hash)``: hashes of all keys that can be among the ``k`` first of a tally.

    Where ``proven`` is false other keys can be, too, and there may be no hash but NULL.
    """
    entries = tally_entries(rows.withColumn("_pos", F.lit(0)), tallies, "_pos")
    sketched = entries.groupBy("tally").agg(
        F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k_accumulate(key, {int(tracked)})").alias("state"))
    named = sketched.select(
        "tally", sketch_error(F.col("total"), tracked).alias("error"),
        F.expr(f"approx_top_k_estimate(state, {int(tracked)})").alias("top"))
    kth = F.coalesce(F.get("top", F.lit(k - 1))["count"], F.lit(0))
    reached = kth - F.col("error")
    proven = (F.col("error") == 0) | (reached > 2 * F.col("error"))
    named = named.select("tally", "top", proven.alias("proven"), (reached - F.col("error")).alias("least"))
    hashes = F.transform(F.filter("top", lambda x: x["count"] >= F.col("least")), lambda x: F.xxhash64(x["item"]))
    return named.select("tally", "proven", F.explode_outer(hashes).alias("hash"))


def candidate_counts(rows: DataFrame, chosen: DataFrame, tallies: tuple[str, ...]) -> DataFrame:
    """:func:`tally_counts` of the chosen keys (and of any that share their 64-bit hash)."""
    chosen = chosen.where(F.col("tally").isin(*tallies)).select(F.col("tally").alias("_tally"), "hash")
    entries = tally_entries(rows, tallies)
    wanted = entries.join(
        F.broadcast(chosen), (F.col("tally") == F.col("_tally")) & (F.xxhash64("key") == F.col("hash")), "left_semi")
    return wanted.groupBy("tally", "key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_seen"))


def two_pass_top_keys(rows: DataFrame, k: int = 10, work: str | None = None, tracked: int = TRACKED,
                      tallies: tuple[str, ...] = TALLIES) -> DataFrame:
    """:func:`top_keys` of all ``rows``, exact, with the keys of most tallies left where they are.

    ``rows`` are read twice, so pass a written table. Candidates and counts are written
    below ``work``, by default the folder that ``spark.checkpoint.dir`` names.
    """
    if k > tracked:
        raise ValueError(f"a sketch of {tracked} items cannot name {k} keys")
    many = tuple(t for t in tallies if t in MANY_KEYS)
    counted = tuple(t for t in tallies if t not in MANY_KEYS)
    parts = []
    if many:
        chosen = landed_at(candidate_keys(rows, k, tracked, many), "candidates", work)
        flags = {r.tally: r.proven for r in chosen.select("tally", "proven").distinct().collect()}
        proven = tuple(t for t in many if flags.get(t))
        counted += tuple(t for t in many if not flags.get(t, True))
        if proven:
            parts.append(candidate_counts(rows, chosen, proven))
    if counted or not parts:
        parts.append(tally_counts(rows, counted or many))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return top_keys(landed_at(counts, "candidate-counts", work), k, landed=True)
