"""Exact figures in passes that shuffle no keys, and states that are merged."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import logspark as ls
from logspark.operators import addresses, candidates, refinement, states
from logspark.operators import tallies as A
from logspark.plans.once import landed_at
from logspark.plans.two_pass import two_pass_report


def rows_of(spark, urls, ips=("10.0.0.1",)):
    lines = [f"2026-07-26 02:51:29 INFO {ips[i % len(ips)]} GET {u} 200 {i % 37}ms" for i, u in enumerate(urls)]
    df = spark.createDataFrame(list(enumerate([*lines, "nothing", "# x", " "])), "pos long, line string").repartition(5, "pos")
    return ls.process(df, ls.JobOptions(reference_time=datetime(2026, 1, 1)))


def zipf(n, keys, seed):
    rng = random.Random(seed)
    return [f"/{int(keys ** rng.random())}" for _ in range(n)]


@pytest.mark.parametrize("tracked", [16, 512])
def test_two_passes_give_the_tallies_of_one(spark, tmp_path, tracked):
    urls = zipf(6000, 3000, 1) + [f"/rare{i}" for i in range(3000)]
    rows = landed_at(rows_of(spark, urls, [f"10.0.{i % 3}.{i}" for i in range(40)]), "rows", str(tmp_path))
    for k in (1, 5, 12):
        want = {tuple(r) for r in A.top_keys(A.tally_counts(rows), k).collect()}
        found = [tuple(r) for r in candidates.two_pass_top_keys(rows, k, str(tmp_path), tracked).collect()]
        assert len(found) == len(want) and set(found) == want
    with pytest.raises(ValueError):
        candidates.two_pass_top_keys(rows, 17, str(tmp_path), 16)


def test_candidates_are_few_and_proven_where_keys_are_skewed(spark, tmp_path):
    rows = landed_at(rows_of(spark, zipf(6000, 3000, 2)), "rows", str(tmp_path))
    chosen = candidates.candidate_keys(rows, 3, 512, ("url",))
    assert {r.proven for r in chosen.collect()} == {True}
    assert 3 <= chosen.count() < 100 < rows.select("url").distinct().count()
    flat = landed_at(rows_of(spark, [f"/{i}" for i in range(3000)]), "flat", str(tmp_path))
    assert [r.proven for r in candidates.candidate_keys(flat, 3, 16, ("url",)).select("proven").distinct().collect()] == [False]


def test_the_first_exchange_carries_sketches(spark, tmp_path):
    rows = landed_at(rows_of(spark, zipf(2000, 500, 3)), "rows", str(tmp_path))
    chosen = candidates.candidate_keys(rows, 3, 512, ("url",))
    plan = spark._jvm.PythonSQLUtils.explainString(chosen._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and "hashpartitioning(tally" in plan and "partial_approx_top_k_accumulate" in plan
    counts = candidates.candidate_counts(rows, landed_at(chosen, "chosen", str(tmp_path)), ("url",))
    plan = spark._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert counts.count() < rows.select("url").distinct().count()


@pytest.mark.parametrize("tracked", [16, 1024])
def test_the_sketch_keeps_to_its_bound(spark, tracked):
    """Estimates of many merged sketches, and all keys they do not name, against exact counts."""
    urls = zipf(20_000, 5000, 4) + [f"/once{i}" for i in range(5000)]
    df = spark.createDataFrame([(u,) for u in urls], "key string").repartition(13)
    grouped = df.agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("s"))
    named = {r["hit"]["item"]: r["hit"]["count"] for r in grouped.select(
        F.explode(F.expr(f"approx_top_k_estimate(s, {tracked})")).alias("hit")).collect()}
    error = spark.range(1).select(candidates.sketch_error(F.lit(len(urls)), tracked)).first()[0]
    exact = {}
    for u in urls:
        exact[u] = exact.get(u, 0) + 1
    assert all(abs(n - exact[u]) <= error for u, n in named.items())
    assert all(n <= 2 * error for u, n in exact.items() if u not in named) or len(named) == tracked


def test_percentiles_by_refinement_are_nearest_rank(spark):
    rnd = random.Random(3)
    fractions = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 1.0}
    mixes = [
        [rnd.choice([rnd.randrange(-5, 5), rnd.randrange(10**6), rnd.randrange(2**62), -rnd.randrange(2**63)]) for _ in range(3000)],
        [2**62 + rnd.randrange(2**40) for _ in range(500)], [7], [0, 0, 0, 1], [-(2**63), 2**63 - 1],
    ]
    for values in mixes:
        df = spark.createDataFrame([(v,) for v in [*values, None]], "value long")
        ordered = sorted(values)
        want = {name: ordered[max(0, math.ceil(f * len(ordered)) - 1)] for name, f in fractions.items()}
        assert refinement.refined_percentiles(df, fractions) == want
        assert refinement.refined_percentiles(df, fractions, cells=3) == want
        counted = df.groupBy("value").agg(F.count("*").alias("n"))
        assert refinement.refined_percentiles(counted, fractions) == want
    assert refinement.refined_percentiles(df.limit(0), fractions) == dict.fromkeys(fractions)


ADDRESSES = ["0.0.0.0", "255.255.255.255", "10.0.0.1", "10.0.0.1", "010.0.0.1", "10.0.0.256", "10.0.0", "::1", "2001:db8::1", "::1",
             "1.2.3.4\n", "", "host", None, *(f"10.1.{i // 250}.{i % 250}" for i in range(1000))]


def test_addresses_are_counted_exactly(spark):
    df = spark.createDataFrame([(a, i % 3) for i, a in enumerate(ADDRESSES)], "ip string, day int").repartition(4)
    one = addresses.distinct_addresses(df).first()
    assert one.unique_ips == len({a for a in ADDRESSES if a is not None}) and one.ipv4 == 1003 and one.other == one.unique_ips - 1003
    days = addresses.address_bitmaps(df, ("day",))
    assert addresses.bits(addresses.merge_bitmaps(days)).first().ipv4 == 1003
    assert addresses.distinct_addresses(df.limit(0)).first().unique_ips == 0
    assert addresses.bits(addresses.address_bitmaps(df.where("ip = 'host'"))).first().ipv4 == 0


def test_the_report_of_two_passes_is_that_of_one(spark, tmp_path, samples):
    (tmp_path / "in.log").write_text("\n".join([*list(samples.values()) * 30, "nothing", "", "# x"]) + "\n")
    results = [ls.run_job(spark, str(tmp_path / "in.log"), options=ls.JobOptions(two_pass=two), work_dir=str(tmp_path / "work"))
               for two in (False, True)]
    one, two = ([sorted(map(tuple, r.tallies.collect()), key=str), r.scalars.collect()] for r in results)
    assert one == two and results[0].tallies.columns == results[1].tallies.columns
    none = landed_at(rows_of(spark, []), "none", str(tmp_path))
    tallies, scalars = two_pass_report(none, 10, str(tmp_path))
    assert tallies.count() == scalars.count() == 0


def test_states_of_days_merge_into_the_figures_of_all(spark, tmp_path, samples):
    urls, ips = zipf(4000, 800, 5), [f"10.0.{i % 7}.{i % 250}" for i in range(500)]
    rows = rows_of(spark, urls, ips).withColumn("day", F.col("pos") % 4).withColumn("half", F.col("pos") % 2)
    rows = landed_at(rows, "rows", str(tmp_path))
    totals = landed_at(states.totals_state(rows, ("day", "half")), "totals", str(tmp_path))
    whole = states.read_totals(states.merge_totals(totals)).first()
    exact = ls.report(rows)[1].first()
    for c in ("parsed", "skipped", "timed", "mean_ms", "rate_4xx", "rate_5xx", "probe_attempts", "probe_successes"):
        assert whole[c] == exact[c]
    assert whole.unique_ips_low <= exact.unique_ips <= whole.unique_ips_high
    assert abs(whole.p50_ms - exact.p50_ms) <= 1 and abs(whole.p95_ms - exact.p95_ms) <= 1
    halves = {r.half: r.parsed for r in states.read_totals(states.merge_totals(totals, ("half",)), ("half",)).collect()}
    assert halves == {0: 2000, 1: 2000}
    tops = landed_at(states.top_state(rows, ("day",), 2048), "tops", str(tmp_path))
    merged = {(r.tally, r.key): r for r in states.read_top(states.merge_top(tops, (), 2048), (), 5, 2048).collect()}
    counts = {(r.tally, r.key): r.n for r in A.tally_counts(rows, ("url",)).collect()}
    assert len([k for k in merged if k[0] == "url"]) == 5
    assert all(abs(r.n - counts[k]) <= r.error for k, r in merged.items() if k[0] == "url")
    empty = states.merge_totals(totals.limit(0))
    assert states.read_totals(empty).count() <= 1 and states.read_top(states.merge_top(tops.limit(0), (), 2048)).count() == 0
    untimed = landed_at(states.totals_state(rows_of(spark, []).withColumn("day", F.lit(1)), ("day",)), "untimed", str(tmp_path))
    assert states.read_totals(untimed).first().p50_ms is None
