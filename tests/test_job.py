import csv
import glob
import gzip
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import logspark as ls
from logspark.functions.redact import anonymise
from logspark.operators import scalars as S
from logspark.operators import tallies as A
from logspark.sources import sinks
from logspark.sources.text_logs import undecoded_gzip
from logspark.streaming.follow import stream_records


@pytest.fixture
def log(tmp_path, samples):
    path = tmp_path / "mixed.log"
    lines = list(samples.values())
    path.write_text("\n".join([*lines[:3], "   ", "no layout has room for this", "#", *lines[3:]]) + "\n")
    return path


def parts(path, pattern="part-*"):
    return sorted(glob.glob(os.path.join(str(path), pattern)))


def run(spark, log, tmp_path, **options):
    csv_at, bad_at = str(tmp_path / "out"), str(tmp_path / "bad")
    result = ls.run_job(spark, str(log), csv_at, bad_at, ls.JobOptions(**options), work_dir=str(tmp_path / "work"))
    return result, csv_at, bad_at


def test_mixed_file(spark, log, tmp_path, samples):
    result, csv_at, bad_at = run(spark, log, tmp_path)
    one = result.scalars.first()
    assert (one.parsed, one.skipped) == (5, 1)
    formats = {r.key for r in result.tallies.where("tally = 'format'").collect()}
    assert formats == set(samples)
    text = "".join(open(p).read() for p in parts(bad_at))
    assert text == "line 5: no layout has room for this\n"
    rows = [row for p in parts(csv_at) for row in csv.reader(open(p, newline=""))]
    assert rows[0] == ["Date", "Time", "TZ", "Level", "IP", "Method", "URL", "Status", "DurationMS", "Bytes", "Format"]
    assert len(rows) == 6 and all(len(r) == 11 for r in rows)
    result.close()
    assert not os.path.exists(result.landed_at.replace("file:", ""))


def test_csv_is_written_as_csv_writer_would(spark, tmp_path):
    import io

    values = [("a,b", 'say "x"', " lead", None), ("", "back\\slash", "tail ", "é")]
    df = spark.createDataFrame(values, "date string, time string, tz string, level string")
    for c in ls.extract.__globals__["RECORD_COLUMNS"][4:]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(["Date", "Time", "TZ", "Level", "IP", "Method", "URL", "Status", "DurationMS", "Bytes", "Format"])
    writer.writerows([["" if v is None else v for v in row] + [""] * 7 for row in values])
    assert open(parts(tmp_path / "c")[0], newline="").read() == out.getvalue()


def test_gzip_in_and_out(spark, samples, tmp_path):
    path = tmp_path / "a.log.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(samples.values()))
    result, csv_at, _ = run(spark, path, tmp_path, gzip=True, partitions=2)
    assert result.scalars.first().parsed == 5
    text = "".join(gzip.open(p, "rt").read() for p in parts(csv_at, "part-*.gz"))
    assert "Date,Time,TZ" in text


def test_ordered_output_keeps_the_order_of_the_lines(spark, tmp_path):
    path = tmp_path / "a.log.gz"
    with gzip.open(path, "wt") as f:
        f.writelines(f"2026-07-26 02:51:28 INFO 10.0.0.5 GET /{i} 200 1ms\n" for i in range(500))
    _, csv_at, _ = run(spark, path, tmp_path, ordered=True, partitions=5)
    rows = [row for p in parts(csv_at) for row in csv.reader(open(p, newline="")) if row[0] != "Date"]
    assert [row[6] for row in rows] == [f"/{i}" for i in range(500)]


def test_gzip_without_its_suffix_is_reported(spark, samples, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.log").write_bytes(gzip.compress("\n".join(samples.values()).encode()))
    (tmp_path / "in" / "a.log").write_text("x\n")
    lines = ls.read_lines(spark, str(tmp_path / "in"), by_content=False)
    assert [os.path.basename(r.file) for r in undecoded_gzip(lines).collect()] == ["b.log"]
    assert undecoded_gzip(ls.read_lines(spark, str(tmp_path / "in"))).count() == 0


def test_summary_only_writes_no_csv(spark, log, tmp_path):
    result = ls.run_job(spark, str(log), work_dir=str(tmp_path / "work"))
    assert result.scalars.first().parsed == 5
    assert not os.path.exists(tmp_path / "out")


def test_a_failed_run_leaves_the_previous_output(spark, log, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old").write_text("previous")
    broken = ls.ColumnLayout("broken", lambda line: F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception):
        run(spark, log, tmp_path, layouts=(broken,))
    assert (tmp_path / "out" / "old").read_text() == "previous"
    with pytest.raises(RuntimeError):
        with sinks.published(spark, str(tmp_path / "out")) as staging:
            spark.range(3).write.parquet(staging)
            raise RuntimeError("boom")
    assert sorted(os.listdir(tmp_path / "out")) == ["old"]
    assert sorted(p for p in os.listdir(tmp_path) if p.startswith("out")) == ["out"]


def test_output_is_replaced_and_clean_runs_keep_old_rejects(spark, log, tmp_path, samples):
    run(spark, log, tmp_path)
    log.write_text(samples["common"] + "\n")
    _, csv_at, bad_at = run(spark, log, tmp_path)
    assert sum(len(open(p).readlines()) - 1 for p in parts(csv_at)) == 1
    assert "no layout" in "".join(open(p).read() for p in parts(bad_at))


def test_invalid_bytes_are_not_fatal(spark, tmp_path, samples):
    path = tmp_path / "binary.log"
    path.write_bytes(samples["fixed8"].encode() + b"\n\xff\xfe bad bytes\n")
    result, _, _ = run(spark, path, tmp_path)
    one = result.scalars.first()
    assert (one.parsed, one.skipped) == (1, 1)


def test_redaction_reaches_every_output(spark, log, tmp_path):
    with open(log, "a") as f:
        f.write("cannot be read: 192.0.2.106 said\n")
    result, csv_at, bad_at = run(spark, log, tmp_path, redact=anonymise)
    written = "".join(open(p).read() for p in parts(csv_at) + parts(bad_at))
    written += str(result.tallies.collect())
    for ip in ("192.0.2.106", "198.51.100.1", "10.0.0.5", "203.0.113.8", "172.16.0.4"):
        assert ip not in written
    assert "192.0.2.0" in written and "line 9: cannot be read: 192.0.2.0 said" in written


def test_year_from_the_file_or_from_the_option(spark, tmp_path):
    path = tmp_path / "old.log"
    path.write_text("Jul 26 02:51:31 WARN x\n")
    os.utime(path, (1564617600, 1564617600))        # 2019-08-01
    result, _, _ = run(spark, path, tmp_path)
    assert result.records.first().date == "2019-07-26"
    result, _, _ = run(spark, path, tmp_path, reference_time=datetime(2021, 3, 1))
    assert result.records.first().date == "2020-07-26"


def test_bad_offset_fails_before_any_job():
    with pytest.raises(ValueError):
        ls.JobOptions(assume_tz="+2500")


def test_line_numbers_over_many_splits_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, count in (("a", 20000), ("b", 7), ("c", 5000)):
        ends = ["\n", "\r\n", "\n", "\n"]
        with open(tmp_path / "in" / name, "w", newline="") as f:
            for i in range(1, count + 1):
                f.write(("" if i % 10 == 0 else f"{name} {i}") + ends[i % 4])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = ls.read_lines(spark, str(tmp_path / "in"))
        some = lines.where("line != ''")
        assert lines.select("file", "block_start").distinct().count() > 12
        wrong = ls.with_line_numbers(some, lines).where(
            F.col("lineno") != F.split("line", " ")[1].cast("long"))
        assert wrong.count() == 0
        assert ls.with_line_numbers(some, lines).count() == 18000 + 7 + 4500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def rows_of(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    return ls.process(df, ls.JobOptions(reference_time=datetime(2019, 1, 1)))


def test_probes_broken_links_and_rates(spark):
    rows = rows_of(spark, [
        "2026-07-26 02:51:29 ERROR 10.0.0.6 GET /wp-login.php 403 12ms",
        "2026-07-26 02:51:30 ERROR 10.0.0.7 GET /contact 404 5ms",
        "2026-07-26 02:51:30 INFO 10.0.0.7 GET /.env 302 5ms",
        '192.0.2.1 - - [10/Oct/2000:13:55:36 -0700] "" 404 1',
        "nothing", "# comment",
    ])
    tallies, one = ls.report(rows)
    got = {(r.tally, r.key): r.n for r in tallies.collect()}
    assert got["probe_path", "/wp-login.php"] == 1 and got["probe_ip", "10.0.0.7"] == 1
    assert got["probe_hit", "302 GET /.env from 10.0.0.7"] == 1
    assert {k: n for (t, k), n in got.items() if t == "broken_link"} == {"/contact": 1, "": 1}
    one = one.first()
    assert (one.parsed, one.skipped, one.unique_ips, one.timed) == (4, 1, 3, 3)
    assert (one.probe_attempts, one.probe_successes, one.rate_4xx, one.rate_5xx) == (2, 1, 75.0, 0.0)
    assert one.mean_ms == pytest.approx(22 / 3) and (one.p50_ms, one.p95_ms) == (5, 12)


def test_no_durations_and_nothing_parsed(spark, samples):
    _, one = ls.report(rows_of(spark, [samples["combined"]]))
    one = one.first()
    assert (one.timed, one.mean_ms, one.p50_ms, one.p95_ms) == (0, None, None, None)
    _, none = ls.report(rows_of(spark, ["garbage"]))
    assert none.count() == 0


def test_ties_go_to_the_key_seen_first(spark):
    lines = [f"2026-07-26 02:51:29 INFO 10.0.0.{i} GET /{i} 200 1ms" for i in (9, 3, 7, 1, 7)]
    tallies, _ = ls.report(rows_of(spark, lines), ls.JobOptions(top=3))
    got = tallies.where("tally = 'ip'").orderBy("rank").collect()
    assert [(r.key, r.n, r.rank) for r in got] == [("10.0.0.7", 2, 1), ("10.0.0.9", 1, 2), ("10.0.0.3", 1, 3)]


def test_percentiles_are_nearest_rank(spark):
    import math
    import random

    rnd = random.Random(3)
    values = [rnd.choice([rnd.randrange(-5, 5), rnd.randrange(10**6), rnd.randrange(2**62)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "value long").groupBy("value").agg(F.count("*").alias("n"))
    fractions = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 1.0}
    row = S.weighted_percentiles(df, fractions).first()
    ordered = sorted(values)
    for name, f in fractions.items():
        assert row[name] == ordered[max(0, math.ceil(f * len(ordered)) - 1)]


def test_sketches_agree_on_small_data(spark, samples):
    rows = rows_of(spark, list(samples.values()) * 20 + ["nothing"]).persist()
    tallies, one = ls.report(rows)
    rough_tallies, rough = ls.report(rows, ls.JobOptions(exact=False))
    a, b = one.first(), rough.first()
    assert a.percentiles_exact and not b.percentiles_exact
    assert [a[c] for c in S.SCALARS if c != "percentiles_exact"] == [b[c] for c in S.SCALARS if c != "percentiles_exact"]
    counts = lambda df: {(r.tally, r.key): r.n for r in df.where("tally in ('ip', 'url')").collect()}
    assert counts(tallies) == counts(rough_tallies)


def test_report_plan(spark, samples):
    rows = rows_of(spark, list(samples.values()))
    counts = A.tally_counts(rows)
    explain = spark._jvm.PythonSQLUtils.explainString
    text = explain(A.top_keys(counts)._jdf.queryExecution(), "formatted")
    assert "WindowGroupLimit" in text and "EvalPython" not in text
    one = A.top_keys(counts)
    one.collect()
    executed = one._jdf.queryExecution().toString().split("== Initial Plan ==")[0].split("== Final Plan ==")[1]
    assert executed.count("Scan ExistingRDD") == 1 and "ReusedExchange" in executed
    plain = explain(counts._jdf.queryExecution(), "simple")
    assert plain.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plain


def test_profile_per_file(spark, samples, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(samples["json"] + "\n" + samples["fixed8"] + "\nnothing\n")
    rows = ls.process(ls.read_lines(spark, str(tmp_path / "in")))
    assert {(os.path.basename(r.file), r.format, r.n) for r in A.format_profile(rows).collect()} == {
        ("a.log", "json", 1), ("a.log", "fixed8", 1)}


def test_the_same_records_from_a_stream(spark, samples, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([*samples.values(), "# x", "nothing 10.0.0.9"]) + "\n")
    rows = stream_records(spark, str(tmp_path / "in"), ls.JobOptions(redact=anonymise, reference_time=datetime(2019, 1, 1)))
    query = rows.writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.format: (r.ip, r.line) for r in spark.table("followed").collect()}
    assert set(got) == {*samples, None}
    assert got["fixed8"][0] == "172.20.1.0" and got[None][1] == "nothing 10.0.0.0"
