"""Gzip by content, line numbers, versions, CSV text and rejected lines, on files."""

import csv
import glob
import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

import logspark as ls
from logspark.schema import RECORD_COLUMNS
from logspark.sources import sinks, text_logs, versions


def write(path, data, packed=False):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(gzip.compress(data) if packed else data)


def read_parts(path):
    return [open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*"))]


def test_gzip_is_told_by_its_first_bytes(spark, samples, tmp_path):
    data = ("\n".join([*samples.values(), "", "junk é"]) + "\n").encode() + b"bad \xff byte\r\nlast without end"
    write(tmp_path / "in" / "plain.log", data)
    write(tmp_path / "in" / "named.log.gz", data, True)
    write(tmp_path / "in" / "a name [1] %41.log", data, True)
    write(tmp_path / "in" / "empty.log", b"")
    write(tmp_path / "in" / "empty packed", b"", True)
    at = str(tmp_path / "in")
    hidden = text_logs.gzip_without_suffix(spark, at)
    assert len(hidden) == 2 and all(any(x in f for x in ("name", "packed")) for f in hidden)
    lines = ls.read_lines(spark, at)
    assert lines.select("pos").distinct().count() == lines.count() == 3 * 9
    by_file = {}
    for r in ls.with_line_numbers(lines, key_lines=2).collect():
        by_file.setdefault(r.file, {})[r.lineno] = r.line
    texts = list(by_file.values())
    assert len(texts) == 3 and texts[0] == texts[1] == texts[2]
    assert texts[0][6] == "" and texts[0][8] == "bad � byte" and texts[0][9] == "last without end"
    result = ls.run_job(spark, at, work_dir=str(tmp_path / "work"))
    one = result.scalars.first()
    assert (one.parsed, one.skipped) == (15, 9)
    as_text = ls.run_job(spark, at, options=ls.JobOptions(by_content=False), work_dir=str(tmp_path / "work")).scalars.first()
    assert as_text.parsed == 10 and as_text.skipped > 6


def test_a_broken_archive_fails_the_run(spark, tmp_path):
    write(tmp_path / "in" / "cut.log", gzip.compress(b"line\n" * 1000)[:-20])
    with pytest.raises(Exception, match="EOFError|end-of-stream"):
        ls.run_job(spark, str(tmp_path / "in"), work_dir=str(tmp_path / "work"))


def test_numbers_of_one_split_are_many_keys(spark, tmp_path):
    write(tmp_path / "in" / "a.log.gz", "".join(f"a {i}\n" for i in range(1, 5001)).encode(), True)
    write(tmp_path / "in" / "b.log.gz", b"b 1\nb 2\n", True)
    lines = ls.read_lines(spark, str(tmp_path / "in"), 4)
    for key_lines in (1, 7, 4096, text_logs.KEY_LINES):
        numbered = ls.with_line_numbers(lines, key_lines=key_lines)
        assert numbered.where(F.col("lineno") != F.split("line", " ")[1].cast("long")).count() == 0 and numbered.count() == 5002
    plan = spark._jvm.PythonSQLUtils.explainString(ls.with_line_numbers(lines, key_lines=7)._jdf.queryExecution(), "simple")
    assert "_range" in [line for line in plan.splitlines() if "Join" in line][0]


def test_readers_see_whole_versions_only(spark, tmp_path):
    at = str(tmp_path / "out")
    assert versions.current(spark, at) is None
    for i in range(1, 5):
        before = versions.current(spark, at)
        with versions.published(spark, at) as place:
            spark.range(i).write.parquet(place)
            assert versions.current(spark, at) == before
        assert spark.read.parquet(versions.current(spark, at)).count() == i
        if before and i > 1:
            assert spark.read.parquet(before).count() == i - 1  # for those who still read it
    assert len(glob.glob(f"{at}/version-*")) == len(glob.glob(f"{at}/_versions/[0-9]*")) == 2
    with pytest.raises(OSError), versions.published(spark, at) as place:
        spark.range(9).write.parquet(place)
        raise OSError
    assert spark.read.parquet(versions.current(spark, at)).count() == 4 and len(glob.glob(f"{at}/version-*")) == 2
    # A pointer that is not complete yet is not followed, and its number is not used again.
    open(f"{at}/_versions/000000000005", "w").write("version-")
    assert spark.read.parquet(versions.current(spark, at)).count() == 4
    with versions.published(spark, at) as place:
        spark.range(6).write.parquet(place)
    assert spark.read.parquet(versions.current(spark, at)).count() == 6


def test_a_versioned_job_replaces_both_outputs(spark, samples, tmp_path):
    log, csv_at, bad_at = tmp_path / "in" / "a.log", str(tmp_path / "csv"), str(tmp_path / "bad")
    for extra in ("", samples["json"] + "\n"):
        write(log, (samples["fixed8"] + "\nnothing\n" + extra).encode())
        ls.run_job(spark, str(log), csv_at, bad_at, ls.JobOptions(versioned=True), str(tmp_path / "work"))
        rows = [r for t in read_parts(versions.current(spark, csv_at)) for r in csv.reader(io.StringIO(t, newline=""))]
        assert len(rows) == 2 + bool(extra) and read_parts(versions.current(spark, bad_at)) == ["line 2: nothing\n"]


def records(spark, values):
    df = spark.createDataFrame([(v, w) for v, w in values], "date string, url string")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RECORD_COLUMNS])


def test_csv_values_keep_their_line_ends(spark, tmp_path):
    values = [("a\nb", "c\r\nd"), ("\r", '"'), (",", " x "), ("", None), ("é\n", "\n")]
    sinks.write_csv(records(spark, values).coalesce(1), str(tmp_path / "c"))
    text, = read_parts(tmp_path / "c")
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    for date, url in values:
        writer.writerow([(date if c == "date" else url if c == "url" else None) or "" for c in RECORD_COLUMNS])
    assert text.split("\r\n", 1)[1] == out.getvalue()


def test_every_part_begins_with_the_header_and_none_is_header_alone(spark, tmp_path):
    sinks.write_csv(records(spark, [(str(i), "x") for i in range(50)]).repartition(3), str(tmp_path / "c"), gzip=True)
    parts = [gzip.open(p, "rt", newline="").read() for p in glob.glob(str(tmp_path / "c" / "part-*.gz"))]
    assert len(parts) == 3 and all(p.startswith("Date,Time,TZ,Level,IP,") for p in parts)
    assert sum(len(p.splitlines()) - 1 for p in parts) == 50
    sinks.write_csv(records(spark, []), str(tmp_path / "none"))
    assert "".join(read_parts(tmp_path / "none")).startswith("Date,Time,TZ") and len("".join(read_parts(tmp_path / "none")).splitlines()) == 1


def test_rejected_lines_are_numbered_once(spark, tmp_path):
    for name in ("b", "a"):
        write(tmp_path / "in" / name, "".join(f"junk {name} {i}\n" if i % 3 else "\n" for i in range(1, 2001)).encode())
    at = str(tmp_path / "bad")
    result = ls.run_job(spark, str(tmp_path / "in"), rejected_output=at, work_dir=str(tmp_path / "work"))
    want = [f"line {i}: junk {name} {i}\n" for name in ("a", "b") for i in range(1, 2001) if i % 3]
    assert "".join(read_parts(at)) == "".join(want)
    plan = result.rejected._jdf.queryExecution().toString()
    assert "Join" not in plan and result.rejected.count() == len(want)
    assert not os.path.exists(f"{at}/_versions")
