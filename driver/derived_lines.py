"""Log lines derived from the ``events`` table, one line per event.

Every part of a line is a function of the event's own columns, so the expected
records can be computed from ``events`` without parsing anything.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_id() -> Column:
    return F.col("event_id")


def user_id() -> Column:
    return F.col("user_id")



def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, spread over all cores by its first column, a unique key.

    The lines made of a row are much more work than the row is to shuffle, and a
    file can be one split however many rows it has.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, columns[0])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def case(selector: Column, *values) -> Column:
    """``values[i]`` where the selector is ``i``, the last value otherwise."""
    values = [v if isinstance(v, Column) else F.lit(v) for v in values]
    out = F.when(selector == 0, values[0])
    for i, value in enumerate(values[1:-1], start=1):
        out = out.when(selector == i, value)
    return out.otherwise(values[-1])


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c % 65536))


def with_parts(ev: DataFrame) -> DataFrame:
    """The pieces a line is put together from."""
    is_v6 = (event_id() % 25 == 0) & (event_id() % 12 != 9)
    v6 = F.concat(F.lit("2001:db8:"), _hex(user_id()), F.lit("::"), _hex(event_id()))
    v4 = F.concat(F.lit("10.0."), (user_id() % 256).cast("string"), F.lit("."), (event_id() % 250).cast("string"))
    block = F.floor(event_id() / 12)
    url = (
        F.when(block % 8 == 0, case(
            F.floor(event_id() / 96) % 6, "/.env", "/.git/config", "/wp-login.php", "/admin/config/db.yml",
            "/docs/.environment-setup", "/blog/using.gitlab-ci"))
        .otherwise(F.concat(
            F.lit("/"), F.col("event_type"), F.lit("/"), user_id().cast("string"),
            F.when(event_id() % 9 == 0, F.concat(F.lit("?token="), event_id().cast("string")))
            .when(event_id() % 5 == 0, F.concat(F.lit("?page="), (event_id() % 7).cast("string")))
            .otherwise(F.lit(""))))
    )
    by_type = F.col("event_type")
    status = (
        F.when(by_type == "view", 200).when(by_type == "click", 304).when(by_type == "purchase", 404)
        .when(by_type == "signup", 403).otherwise(503)
    )
    level = (
        F.when(by_type == "view", "info").when(by_type == "click", "debug").when(by_type == "purchase", "notice")
        .when(by_type == "signup", "warning").otherwise("error")
    )
    whole = F.floor(F.col("value")).cast("bigint")
    seconds = F.concat(
        F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(" s"))
    millis = F.concat(F.col("value").cast("string"), F.lit("ms"))
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
        (event_id() % 12).alias("kind"),
        case(event_id() % 5, "+0000", "-0700", "+0200", "+0530", "").alias("offset"),
        F.when(is_v6, v6).otherwise(v4).alias("ip"),
        case(F.floor(event_id() / 96) % 4, "GET", "POST", "HEAD", "PUT").alias("method"),
        url.alias("url"),
        status.cast("string").alias("status"),
        level.alias("level"),
        F.when(block % 3 == 0, seconds).otherwise(millis).alias("took"),
        (event_id() * 7 % 24000).cast("string").alias("size"),
    )


def _zone(separator: str, colon: bool = False) -> Column:
    offset = F.col("offset")
    if colon:
        offset = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))
    return F.when(F.col("offset") == "", "").otherwise(F.concat(F.lit(separator), offset))


def _json(**pairs: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def common_line() -> Column:
    """Common log; without a duration, as that layout is the short form here."""
    size = F.when(event_id() % 7 == 3, "-").otherwise(F.col("size"))
    return F.concat(
        F.col("ip"), F.lit(" - - ["), F.date_format(F.col("ts"), "dd/MMM/yyyy:HH:mm:ss"), _zone(" "), F.lit('] "'),
        F.col("method"), F.lit(" "), F.col("url"), F.lit(' HTTP/1.1" '), F.col("status"), F.lit(" "), size)


def combined_line() -> Column:
    """Combined log with a timing tail; agent and referrer are empty on every 4th."""
    agent = F.when(event_id() % 4 == 0, ' "" "" ').otherwise(' "-" "Mozilla/5.0 (X11; Linux x86_64)" ')
    return F.concat(common_line(), agent, F.col("took"))


def fixed8_line() -> Column:
    level = F.upper("level")
    level = F.when(event_id() % 2 == 0, F.concat(F.lit("["), level, F.lit("]"))).otherwise(level)
    return F.concat_ws(
        " ", F.concat(F.col("ts").cast("string"), _zone("", colon=True)), level,
        F.col("ip"), F.col("method"), F.col("url"), F.col("status"), F.col("took"))


def json_line() -> Column:
    """Three producers, with different keys and value types."""
    iso = _quoted(F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), _zone("", colon=True)))
    text = {name: _quoted(F.col(name)) for name in ("level", "ip", "method", "url", "status", "took", "size")}
    request = _quoted(F.concat(F.col("method"), F.lit(" "), F.col("url"), F.lit(" HTTP/1.1")))
    return case(
        event_id() % 3,
        _json(**{"timestamp": iso, "level": text["level"], "client_ip": text["ip"], "method": text["method"],
                 "url": text["url"], "status": F.col("status"), "duration_ms": F.col("value").cast("string"),
                 "bytes": F.col("size")}),
        _json(**{"@timestamp": iso, "severity": text["level"], "remote_addr": text["ip"], "request": request,
                 "status_code": text["status"], "latency": text["took"], "body_bytes_sent": text["size"]}),
        _json(**{"ts": iso, "log_level": text["level"], "ip": F.lit("null"), "host": text["ip"],
                 "verb": text["method"], "path": text["url"], "code": F.col("status"), "took_ms": text["took"],
                 "size": F.col("size")}),
    )


def generic_line() -> Column:
    return F.concat(
        F.col("ts").cast("string"), F.lit(" "), F.upper("level"), F.lit(": upstream slow for "), F.col("ip"),
        F.lit(" "), F.col("method"), F.lit(" "), F.col("url"), F.lit(" status="), F.col("status"),
        F.lit(" took "), F.col("took"))


def rejected_line() -> Column:
    tail = case(
        event_id() % 3,
        F.concat(F.lit("Bearer abcdefgh"), event_id().cast("string")),
        F.concat(F.lit("user"), user_id().cast("string"), F.lit("@example.com")),
        F.concat(F.lit("password=pw"), event_id().cast("string")))
    return F.concat(F.lit("could not read request from "), F.col("ip"), F.lit(" sent "), tail)


def dropped_line() -> Column:
    return F.when(event_id() % 24 == 11, "   ").otherwise(F.concat(F.lit("# rotated "), event_id().cast("string")))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, line)``: a mixed-format log in event order."""
    kind = F.col("kind")
    line = (
        F.when(kind <= 3, combined_line()).when(kind == 4, common_line()).when(kind <= 6, json_line())
        .when(kind <= 8, fixed8_line()).when(kind == 9, generic_line()).when(kind == 10, rejected_line())
        .otherwise(dropped_line())
    )
    return with_parts(events(spark, sf_dir)).select(F.col("event_id").alias("pos"), line.alias("line"))


def lines_of(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """``(pos, line)`` with every event in the same layout."""
    return with_parts(events(spark, sf_dir)).select(F.col("event_id").alias("pos"), line.alias("line"))
