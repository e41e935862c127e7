from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.functions import fields as X
from logspark.functions import timestamps as T
from logspark.functions.text import WHITE_SPACE, number_groups, strip, unicode_space
from logspark.functions.urls import describe_hit, is_suspicious, path_segments


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def column(df, c):
    return [row[0] for row in df.orderBy("i").select(c).collect()]


def test_white_space_is_what_python_strips(spark):
    assert WHITE_SPACE == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    values = [f"{c} x{c}y {c}" for c in WHITE_SPACE] + ["plain", "", "é ", None]
    got = column(texts(spark, values), strip(F.col("t")))
    assert got == [v if v is None else v.strip() for v in values]


def test_unicode_space_inside_and_outside_classes():
    assert unicode_space(r"\\s") == r"\\s"
    assert "[" not in unicode_space(r"[^\s&]")[2:]


def test_groups_are_numbered_like_java_does():
    assert number_groups(r"\(([(])(?<a>x)(?:y)(?<!z)(?<b>(q))") == {"a": 2, "b": 3}


def test_status(spark):
    values = ["404", "40", "okay", " 200 ", "200.0", "", None, "+12"]
    assert column(texts(spark, values), X.to_status(F.col("t"))) == [404, None, None, 200, None, None, None, None]


DURATIONS = [
    ("143.6", 144), ("0.250 s", 250), ("1.5 s", 1500), ("2.5", 2), ("3.5ms", 4), ("fast", None), ("", None),
    (None, None), ("nan", None), ("inf", None), ("1e400", None), ("5d", None), ("1_000", 1000), ("-5", -5),
    ("took 12 ms or 3 s", 12), ("5.s", None), ("1e3", 1000),
]


def test_duration(spark):
    got = column(texts(spark, [t for t, _ in DURATIONS]), X.duration_ms(F.col("t")))
    assert list(zip([t for t, _ in DURATIONS], got)) == DURATIONS


def test_request_split(spark):
    values = ["GET /path HTTP/1.1", "GET /path", "garbage here", "get /x", "TOOLONGVERB /x", "GET /a b c", ""]
    assert column(texts(spark, values), X.split_request(F.col("t"))) == [
        ["GET", "/path"], ["GET", "/path"], ["garbage here"], ["get /x"], ["TOOLONGVERB /x"], ["GET /a b c"], [""]]


def test_offsets(spark):
    values = ["Z", "utc", "GMT", "+02:00", "-0700", "+1400", "+1401", "-1201", "+2500", "+0260", "0200", "", None]
    assert column(texts(spark, values), T.normalise_offset(F.col("t"))) == [
        "+0000", "+0000", "+0000", "+0200", "-0700", "+1400", None, None, None, None, None, None, None]
    assert T.checked_offset("+02:00") == "+0200"
    with pytest.raises(ValueError):
        T.checked_offset("+2500")


REFERENCE = datetime(2019, 1, 1)
TIMESTAMPS = [
    ("10/Oct/2000:13:55:36 -0700", "2000-10-10", "20:55:36", "-0700"),
    ("10/Oct/2000:13:55:36 +0200", "2000-10-10", "11:55:36", "+0200"),
    ("10/Oct/2000:01:00:00 +0200", "2000-10-09", "23:00:00", "+0200"),
    ("10/oct/2000 1:2:3", "2000-10-10", "01:02:03", None),
    ("2026-07-26T02:51:30Z", "2026-07-26", "02:51:30", "+0000"),
    ("2026-07-26T02:51:30+05:30", "2026-07-25", "21:21:30", "+0530"),
    ("Jul 30 2026 at 05:12:34", "2026-07-30", "05:12:34", None),
    ("Jul  6 2026 05:12:34", "2026-07-06", "05:12:34", None),
    ("2026-07-26 02:51:30.123", "2026-07-26", "02:51:30", None),
    ("2026-07-26 02:51:30,5 UTC", "2026-07-26", "02:51:30", "+0000"),
    ("2026.5 -07-26", "2026", "-07-26", None),
    ("Jul.5 6 2026 05:12:34", "2026-07-06", "05:12:34", None),
    ("[ 2026-07-26 02:51:30 +0200]", "2026-07-26", "00:51:30", "+0200"),
    ("[2026-07-26 02:51:30 ]", "2026-07-26", "02:51:30 ", None),
    ("2026/07/26 02:51:30", "2026-07-26", "02:51:30", None),
    ("26/Jul/2026", "2026-07-26", "00:00:00", None),
    ("2026-07-26", "2026-07-26", "00:00:00", None),
    ("Jul 26 02:51:31", "2018-07-26", "02:51:31", None),
    ("Jan  1 23:00:00", "2019-01-01", "23:00:00", None),
    ("Jan 2 00:00:00", "2019-01-02", "00:00:00", None),
    ("Jan 2 00:00:01", "2018-01-02", "00:00:01", None),
    ("Feb 29 12:00:00", "Feb", "29 12:00:00", None),
    ("2026-02-30 01:00:00 +0200", "2026-02-30", "01:00:00", "+0200"),
    ("2026-07-26 02:51:60", "2026-07-26", "02:51:60", None),
    ("0000-01-01", "0000-01-01", None, None),
    ("10/Oct/2000:13:55:36 +2500", "10/Oct/2000:13:55:36", "+2500", None),
    ("whenever o'clock", "whenever", "o'clock", None),
    ("1700000000", "1700000000", None, None),
    ("", None, None, None),
    (None, None, None, None),
]


def test_timestamps(spark):
    df = texts(spark, [t[0] for t in TIMESTAMPS])
    rows = T.with_timestamp(df, "t", reference=REFERENCE).orderBy("i").collect()
    assert [(r.t, r.date, r.time, r.tz) for r in rows] == TIMESTAMPS
    assert rows[0].event_ts == datetime(2000, 10, 10, 20, 55, 36)
    assert rows[-3].event_ts is None


def test_assumed_zone(spark):
    df = texts(spark, ["2026-07-26 02:51:30", "2026-07-26 02:51:30 Z", "whenever o'clock", "x y +0100"])
    rows = T.with_timestamp(df, "t", assume_tz="+02:00").orderBy("i").collect()
    assert [(r.date, r.time, r.tz) for r in rows] == [
        ("2026-07-26", "00:51:30", "+0200"), ("2026-07-26", "02:51:30", "+0000"),
        ("whenever", "o'clock", None), ("x", "y", "+0100")]


def test_year_comes_from_a_column(spark):
    df = spark.createDataFrame([("Jul 26 02:51:31", datetime(2019, 8, 1))], "t string, m timestamp_ntz")
    assert T.with_timestamp(df, "t", reference="m").first().date == "2019-07-26"


PATHS = [
    ("/WP-LOGIN.php", True), ("/.env", True), ("/.env.production", True), ("/environment", False), ("", False),
    (None, False), ("/%2egit/config", True), ("/..\\.env", True), ("/docs/.environment-setup", False),
    ("/blog/using.gitlab-ci", False), ("/admin/config", True), ("/admin//config/db.yml", True),
    ("/admin/x/config", False), ("/a?next=/.env", False), ("/a%zz+b/id_rsa#x", True), ("/%252egit", False),
]


def test_suspicious_paths(spark):
    df = texts(spark, [p[0] for p in PATHS])
    assert column(df, is_suspicious(F.col("t"))) == [p[1] for p in PATHS]


def test_path_segments(spark):
    df = texts(spark, ["/A/b%20c//d+e?x=/y", "/%zz%41", None])
    assert column(df, path_segments(F.col("t"))) == [["a", "b c", "d+e"], ["%zza"], []]


def test_hit_label(spark):
    df = spark.sql("select 0 i, 200 s, cast(null as string) m, '/.env' u, cast(null as string) ip")
    assert column(df, describe_hit(F.col("s"), F.col("m"), F.col("u"), F.col("ip"))) == ["200 ? /.env from unknown"]
