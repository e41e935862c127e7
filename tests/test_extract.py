from datetime import datetime

import pytest
from pyspark.sql import functions as F

import logspark as ls


def records(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return ls.extract(df, reference_time=datetime(2019, 1, 1), **options).orderBy("i").collect()


def one(spark, line, **options):
    return records(spark, [line], **options)[0]


def test_each_sample_has_its_own_format(spark, samples):
    rows = records(spark, list(samples.values()))
    assert [r.format for r in rows] == list(samples)


def test_combined_fields(spark, samples):
    r = one(spark, samples["combined"])
    assert (r.date, r.time, r.tz, r.level, r.ip, r.method, r.url, r.status, r.duration_ms, r.bytes) == (
        "2024-03-03", "20:40:07", "+0100", None, "198.18.4.77", "DELETE", "/cart/18", 409, None, "512")


CLF = '192.0.2.1 - - [10/Oct/2000:13:55:36 -0700] '


TAILS = [
    ('"GET / HTTP/1.1" 304 -', ("common", "GET", "/", 304, None, None)),
    ('"GET / HTTP/1.1" 304 0', ("common", "GET", "/", 304, None, "0")),
    ('"GET /.env HTTP/1.1" 404 0 "-" "curl/8.0" 0.250 s', ("combined", "GET", "/.env", 404, 250, "0")),
    ('"GET / HTTP/1.1" 200 1 "" ""', ("combined", "GET", "/", 200, None, "1")),
    ('"GET / HTTP/1.1" 200 1 12', ("common", "GET", "/", 200, 12, "1")),
    ('" garbage here " 400 1', ("common", None, "garbage here", 400, None, "1")),
    ('"" 400 1', ("common", None, None, 400, None, "1")),
    ('"GET /a b c" 400 1', ("common", None, "GET /a b c", 400, None, "1")),
]


def test_access_log_tails(spark):
    rows = records(spark, [CLF + tail for tail, _ in TAILS])
    assert [(r.format, r.method, r.url, r.status, r.duration_ms, r.bytes) for r in rows] == [e for _, e in TAILS]


def test_access_log_that_does_not_fit(spark):
    rows = records(spark, [CLF + t for t in ('"GET /" 20 1', '"GET /" 200 x', '"GET /" 200 1 "a"', '"GET /" 200 1 2 3')])
    assert [r.format for r in rows] == [None] * 4


def test_fixed8(spark):
    rows = records(spark, [
        "2026-07-26 02:51:29 [error] 10.0.0.6 POST /wp-login.php 403 12ms",
        "2026/07/26T02:51:29.5+05:30 WARN 2001:db8::1 GET /x 200 1.5 s",
        "2026-07-26 02:51:28 UTC INFO 10.0.0.5 GET /x 200 7",
    ])
    assert [(r.date, r.time, r.tz, r.level, r.ip, r.duration_ms) for r in rows] == [
        ("2026-07-26", "02:51:29", None, "ERROR", "10.0.0.6", 12),
        ("2026-07-25", "21:21:29", "+0530", "WARN", "2001:db8::1", 1500),
        ("2026-07-26", "02:51:28", "+0000", "INFO", "10.0.0.5", 7)]


def test_json_sample(spark, samples):
    r = one(spark, samples["json"])
    assert (r.level, r.ip, r.method, r.url, r.status, r.duration_ms, r.bytes) == (
        "ERROR", "198.51.100.61", "POST", "/orders", 502, 1203, "40")


def test_json_aliases(spark):
    r = one(spark, '{"@timestamp":"2026-07-26 01:02:03","severity":"error","remote_addr":"192.0.2.9","ip":"",'
                   '"uri":"/x","response_code":"503","latency":"1.5 s","body_bytes_sent":12,"host":"later"}')
    assert (r.date, r.level, r.ip, r.url, r.status, r.duration_ms, r.bytes) == (
        "2026-07-26", "ERROR", "192.0.2.9", "/x", 503, 1500, "12")


JSON_VALUES = [
    ('{"bytes":0}', "bytes", None), ('{"bytes":"0"}', "bytes", "0"), ('{"bytes":0.0}', "bytes", None),
    ('{"url":false}', "url", None), ('{"url":"false"}', "url", "false"), ('{"url":true}', "url", "True"),
    ('{"ip":[]}', "ip", None), ('{"ip":"[]"}', "ip", "[]"), ('{"ts":0}', "date", None), ('{"ts":"0"}', "date", "0"),
    ('{"bytes":"","size":"0"}', "bytes", "0"), ('{"bytes":"","size":0}', "bytes", None),
    ('{"duration":true}', "duration_ms", 1), ('{"duration":"true"}', "duration_ms", None),
    ('{"duration":0}', "duration_ms", 0), ('{"duration":["5 s"]}', "duration_ms", None),
    ('{"duration":"[5 s]"}', "duration_ms", 5000), ('{"duration":"12 sec"}', "duration_ms", None),
    ('{"duration":NaN}', "duration_ms", None), ('{"duration":2.5}', "duration_ms", 2),
    ('{"status":200.0}', "status", None), ('{"status":" 200 "}', "status", 200),
    ('{"url":" /x "}', "url", " /x "), ('{"url":" GET /x "}', "url", "/x"),
    ('{"method":"PUT","url":"GET /x"}', "method", "PUT"), ('{"ip":"a","ip":"b"}', "ip", "b"),
    ('{"ip":"a","ip":null,"host":"h"}', "ip", "h"), ('{"IP":"a"}', "ip", None),
]


def test_json_values(spark):
    rows = records(spark, [line for line, _, _ in JSON_VALUES])
    assert {r.format for r in rows} == {"json"}
    got = [(line, field, r[field]) for r, (line, field, _) in zip(rows, JSON_VALUES)]
    assert got == JSON_VALUES


def test_json_that_is_none(spark):
    lines = ['{"not": ', "[1, 2, 3]", '{"a":1} junk}', '{"a":1} {"b":2}', "{'a':1}", '{"a":1,}', '{"a":{"b":1}',
             '{"a":1}} {"a":1}', '{"a":"x}', '{"a":"b\tc"}']
    assert [r.format for r in records(spark, lines)] == [None] * len(lines)
    assert [r.format for r in records(spark, ["{}", "{ }"])] == ["json", "json"]


def test_generic_details_come_from_the_message(spark, samples):
    r = one(spark, samples["generic"])
    assert (r.date, r.level, r.ip, r.method, r.url, r.status, r.duration_ms) == (
        "2018-09-14", "NOTICE", "192.168.7.8", "GET", "/feed", 504, 95)
    r = one(spark, "[2026-07-26 02:51:31] [Critical] - Code: 404 in 2 s")
    assert (r.level, r.ip, r.url, r.status, r.duration_ms) == ("CRITICAL", None, None, 404, 2000)
    assert one(spark, "2026-07-26 02:51:31Z INFO x").format is None


def test_lines_that_fit_nothing(spark):
    rows = records(spark, ["no layout has room for this", None, "two\nlines", "日本語"])
    assert [r.format for r in rows] == [None] * 4


def test_white_space_beyond_ascii(spark):
    r = one(spark, CLF.replace(" - - ", " - - ") + '"GET　/x" 200 1')
    assert (r.format, r.url) == ("common", "/x")
    assert one(spark, "2026-07-26 02:51:28 INFO 10.0.0.5 GET /a b 200 7").format == "generic"


def test_blank_lines_and_comments(spark):
    df = spark.createDataFrame([("  ",), ("",), (" # x",), (" a ",), ("#",)], "line string")
    assert [r.line for r in ls.meaningful_lines(df).collect()] == ["a"]


def test_layouts_can_be_added_and_reordered(spark, samples):
    pipe = ls.RegexLayout("pipe", r"(?<ts>[^|]+)\|(?<ip>[^|]*)\|(?<request>.*)")
    key = ls.ColumnLayout("key", lambda line: F.when(
        line.startswith("url="), ls.raw_struct(format=F.lit("key"), url=F.substring_index(line, "=", -1))))
    lines = ["2026-01-02|192.0.2.1|GET /x", "url=/y", samples["fixed8"]]
    rows = records(spark, lines, layouts=(pipe, key, *ls.DEFAULT_LAYOUTS))
    assert [(r.format, r.date, r.ip, r.method, r.url) for r in rows] == [
        ("pipe", "2026-01-02", "192.0.2.1", "GET", "/x"), ("key", None, None, None, "/y"),
        ("fixed8", "2025-11-02", "172.20.1.9", "PATCH", "/profile/7")]
    first = records(spark, [samples["fixed8"]], layouts=(ls.GENERIC, ls.FIXED8))[0]
    assert first.format == "generic"
    with pytest.raises(ValueError):
        ls.RegexLayout("none", "(?<ip>x)")


def test_assumed_zone_reaches_every_layout(spark, samples):
    rows = records(spark, list(samples.values()), assume_tz="+0200")
    assert [r.tz for r in rows] == ["+0100", "+0000", "+0200", "+0200", "+0200"]
    assert rows[2].time == "15:06:45"


def plan(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_plan_matches_each_line_once_and_stays_in_the_jvm(spark):
    import re

    df = spark.createDataFrame([("x",)], "line string")
    rows = ls.parsed(ls.extract(ls.meaningful_lines(df))).where("status = 404 and date = '2026-01-01'")
    text = plan(rows, "extended").split("== Physical Plan ==")[1]
    assert text.count("(?<L0ip>") == 1
    assert "EvalPython" not in text and "Exchange" not in text
    # A larger method would be left to the interpreter by the JIT compiler.
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan(rows, "codegen"))]
    assert max(sizes) < 8000


def test_a_query_on_status_does_not_parse_timestamps(spark):
    df = spark.createDataFrame([("x",)], "line string")
    text = plan(ls.parsed(ls.extract(df)).groupBy("status").count(), "extended").split("== Physical Plan ==")[1]
    assert "timestamp_ntz" not in text


def test_inline_flags_of_a_layout_end_with_it(spark):
    mine = ls.RegexLayout("mine", r"(?i)mine (?<ts>\S+)")
    rows = records(spark, ["MINE 2026-01-02", "2026-07-26 02:51:28 INFO 10.0.0.5 get /x 200 7ms"],
                   layouts=(mine, *ls.DEFAULT_LAYOUTS))
    assert rows[0].format == "mine" and rows[1].format != "fixed8"


def test_references_are_named_or_refused(spark):
    with pytest.raises(ValueError, match="by number"):
        ls.RegexLayout("rep", r"([a-z])-\1 (?<ts>\S+)")
    named = ls.RegexLayout("rep", r"(?<level>[a-z]+)-\k<level> (?<ts>\S+)")
    rows = records(spark, ["a-a 2026-01-02", "a-b 2026-01-02"], layouts=(*ls.DEFAULT_LAYOUTS, named))
    assert [r.format for r in rows] == ["rep", None]


def test_text_may_hold_what_separates_parts(spark):
    rows = records(spark, ['{"url":"/a\\nb","status":404}', '{"request":"GET /a\\nSet-Cookie: x"}',
                           '{"timestamp":"2026\\u0001x"}'])
    assert [(r.method, r.url) for r in rows[:2]] == [(None, "/a\nb"), (None, "GET /a\nSet-Cookie: x")]
    assert (rows[2].date, rows[2].tz) == ("2026\x01x", None)
