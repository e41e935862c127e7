"""The expected results in SQL, computed from the tables' own columns.

None of these parses a line: they state which record every event's line stands
for. Only the redaction of free text repeats patterns, in RE2 syntax.
"""

from driver.query_set import EXACT_TOTALS, URL_SUFFIXES
from logspark import fixed_values as V

# The pieces of every event's line, and what they should come out as.
PARTS = """
parts AS (
  SELECT event_id, user_id, event_type, value, date_trunc('second', ts) AS ts, event_id % 12 AS kind,
    CASE event_id % 5 WHEN 0 THEN '+0000' WHEN 1 THEN '-0700' WHEN 2 THEN '+0200' WHEN 3 THEN '+0530' END AS tz,
    CASE event_id % 5 WHEN 1 THEN -420 WHEN 2 THEN 120 WHEN 3 THEN 330 ELSE 0 END AS minutes,
    event_id % 25 = 0 AND event_id % 12 <> 9 AS is_v6,
    to_hex(user_id % 65536) AS user_hex,
    '10.0.' || (user_id % 256) || '.' || (event_id % 250) AS v4,
    '2001:db8:' || lower(to_hex(user_id % 65536)) || '::' || lower(to_hex(event_id % 65536)) AS v6,
    ['GET', 'POST', 'HEAD', 'PUT'][1 + (event_id // 96) % 4] AS method,
    (event_id // 12) % 8 = 0 AS scan_like,
    (event_id // 12) % 8 = 0 AND (event_id // 96) % 6 < 4 AS is_probe,
    CASE WHEN (event_id // 12) % 8 = 0 THEN
      ['/.env', '/.git/config', '/wp-login.php', '/admin/config/db.yml',
       '/docs/.environment-setup', '/blog/using.gitlab-ci'][1 + (event_id // 96) % 6]
    ELSE '/' || event_type || '/' || user_id ||
      CASE WHEN event_id % 9 = 0 THEN '?token=' || event_id
           WHEN event_id % 5 = 0 THEN '?page=' || (event_id % 7) ELSE '' END
    END AS url,
    CAST(CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 304 WHEN 'purchase' THEN 404
         WHEN 'signup' THEN 403 ELSE 503 END AS INTEGER) AS status,
    CASE event_type WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' WHEN 'purchase' THEN 'NOTICE'
         WHEN 'signup' THEN 'WARNING' ELSE 'ERROR' END AS level,
    CAST(round_even(value, 0) AS BIGINT) AS value_ms,
    CASE WHEN (event_id // 12) % 3 = 0 THEN CAST(floor(value) AS BIGINT)
         ELSE CAST(round_even(value, 0) AS BIGINT) END AS took_ms,
    CAST(event_id * 7 % 24000 AS VARCHAR) AS size
  FROM events
)"""


def records(layout: str) -> str:
    """The record of every event if its line is in the given layout."""
    zoned = layout != "generic"
    stamp = "ts - to_minutes(minutes)" if zoned else "ts"
    size = {
        "combined": "CASE WHEN event_id % 7 <> 3 THEN size END",
        "common": "CASE WHEN event_id % 7 <> 3 THEN size END",
        "json": "CASE WHEN event_id % 3 = 1 OR size <> '0' THEN size END",
    }.get(layout, "CAST(NULL AS VARCHAR)")
    took = {
        "common": "CAST(NULL AS BIGINT)",
        "json": "CASE WHEN event_id % 3 = 0 THEN value_ms ELSE took_ms END",
    }.get(layout, "took_ms")
    ip = "CASE WHEN NOT is_v6 THEN v4 END" if layout == "generic" else "CASE WHEN is_v6 THEN v6 ELSE v4 END"
    return f"""
      SELECT event_id, strftime({stamp}, '%Y-%m-%d') AS date, strftime({stamp}, '%H:%M:%S') AS time,
        {'tz' if zoned else 'CAST(NULL AS VARCHAR)'} AS tz,
        {'CAST(NULL AS VARCHAR)' if layout in ('combined', 'common') else 'level'} AS level,
        {ip} AS ip, method, url, status, {took} AS duration_ms, {size} AS bytes, '{layout}' AS format"""


def one_layout(layout: str) -> str:
    return f"WITH {PARTS} {records(layout)} FROM parts"


KINDS = {"combined": "kind <= 3", "common": "kind = 4", "json": "kind IN (5, 6)",
         "fixed8": "kind IN (7, 8)", "generic": "kind = 9"}
MIXED = f"""WITH {PARTS},
records AS (
  {' UNION ALL '.join(f'{records(layout)}, is_probe FROM parts WHERE {where}' for layout, where in KINDS.items())}
)"""
REJECTED = """
  'could not read request from ' || {ip} || ' sent ' || CASE event_id % 3
    WHEN 0 THEN {bearer} WHEN 1 THEN {email} ELSE {password} END"""
REJECTED_PLAIN = REJECTED.format(
    ip="CASE WHEN is_v6 THEN v6 ELSE v4 END", bearer="'Bearer abcdefgh' || event_id",
    email="'user' || user_id || '@example.com'", password="'password=pw' || event_id")
MASKED_V4 = "'10.0.' || (user_id % 256) || '.0'"
MASKED_V6 = "CASE WHEN user_id % 65536 = 0 THEN '2001:db8::' ELSE '2001:db8:' || lower(user_hex) || '::' END"
MASKED_IP = f"CASE WHEN is_v6 THEN {MASKED_V6} ELSE {MASKED_V4} END"
REJECTED_MASKED = REJECTED.format(
    ip=MASKED_IP, bearer="'Bearer ***'", email="'***@example.com'", password="'password=***'")
MASKED_URL = "CASE WHEN contains(url, '?token=') THEN regexp_replace(url, 'token=.*', 'token=***') ELSE url END"

# tally: (which records count, the key they count under)
TALLIES = {
    "format": ("true", "format"),
    "status_class": ("status IS NOT NULL", "(status // 100) || 'xx'"),
    "level": ("level IS NOT NULL", "level"),
    "ip": ("ip IS NOT NULL", "ip"),
    "url": ("url IS NOT NULL", "url"),
    "probe_ip": ("is_probe", "coalesce(ip, 'unknown')"),
    "probe_path": ("is_probe", "url"),
    "probe_hit": ("is_probe AND status < 400", "status || ' ' || method || ' ' || url || ' from ' || coalesce(ip, 'unknown')"),
    "broken_link": ("NOT is_probe AND status BETWEEN 400 AND 499", "url"),
}


def tally(name: str, source: str = "records") -> str:
    where, key = TALLIES[name]
    order = "key" if name == "status_class" else "n DESC, first_seen"
    limit = "" if name in ("format", "status_class") else "WHERE rank <= 10"
    return f"""
      SELECT key, n, rank FROM (
        SELECT key, n, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM (
          SELECT {key} AS key, count(*) AS n, min(event_id) AS first_seen FROM {source} WHERE {where} GROUP BY 1
        )) {limit}"""


def mixed(select: str) -> str:
    return f"{MIXED} {select}"


PERCENTILE = """(
    SELECT max(duration_ms) FROM (
      SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS r, count(*) OVER () AS n
      FROM records WHERE duration_ms IS NOT NULL
    ) WHERE r <= greatest(1, ceil(CAST({f} AS DOUBLE) * n)))"""
TOTALS = f"""
  SELECT count(*) AS parsed, (SELECT count(*) FROM parts WHERE kind = 10) AS skipped,
    count(DISTINCT ip) AS unique_ips, count(duration_ms) AS timed,
    CAST(sum(duration_ms) AS DOUBLE) / CAST(count(duration_ms) AS DOUBLE) AS mean_ms,
    {PERCENTILE.format(f=0.5)} AS p50_ms, {PERCENTILE.format(f=0.95)} AS p95_ms, true AS percentiles_exact,
    CAST(count(*) FILTER (status // 100 = 4) AS DOUBLE) / CAST(count(status) AS DOUBLE) * 100 AS rate_4xx,
    CAST(count(*) FILTER (status // 100 = 5) AS DOUBLE) / CAST(count(status) AS DOUBLE) * 100 AS rate_5xx,
    count(*) FILTER (is_probe) AS probe_attempts,
    count(*) FILTER (is_probe AND status < 400) AS probe_successes
  FROM records"""

# --- timestamps -----------------------------------------------------------------------------

WRITTEN_TZ = "CASE event_id % 5 WHEN 0 THEN '+0000' WHEN 1 THEN '-0700' WHEN 2 THEN '+0200' WHEN 3 THEN '+0530' END"


def stamps(assumed: bool) -> str:
    utc = "ts - to_minutes(minutes)"
    tz = WRITTEN_TZ
    if assumed:
        utc = "ts - to_minutes(CASE WHEN event_id % 5 = 4 THEN 120 ELSE minutes END)"
        tz = f"coalesce({WRITTEN_TZ}, '+0200')"
    return f"""WITH {PARTS} SELECT event_id, strftime({utc}, '%Y-%m-%d') AS date,
        strftime({utc}, '%H:%M:%S') AS time, {tz} AS tz FROM parts"""


YEARLESS = f"""WITH {PARTS}, dated AS (
    SELECT event_id, CASE WHEN make_timestamp(2024, month(ts), day(ts), hour(ts), minute(ts), second(ts))
        > TIMESTAMP '2024-01-16 00:00:00' THEN '2023' ELSE '2024' END AS year, ts FROM parts)
  SELECT event_id, year || strftime(ts, '-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time,
    CAST(NULL AS VARCHAR) AS tz FROM dated"""
PASSTHROUGH = f"""WITH {PARTS} SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN strftime(ts, '%d/%b/%Y:%H:%M:%S') WHEN 1 THEN '2024-02-30' WHEN 2 THEN 'whenever'
      WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN '1700' || event_id ELSE 'Feb' END AS date,
    CASE event_id % 6 WHEN 0 THEN '+2500' WHEN 1 THEN '10:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0')
      WHEN 2 THEN 'o''clock ' || event_id WHEN 3 THEN strftime(ts, '%H:%M:') || '60'
      WHEN 5 THEN '29 12:00:00' END AS time,
    CASE event_id % 6 WHEN 1 THEN '+0200' END AS tz
  FROM parts"""

# --- URLs --------------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PAGE_PATHS = f"""WITH paths AS (
    SELECT page_id, lower(replace(url_decode(split_part(split_part(
      url || [{', '.join(map(_text, URL_SUFFIXES))}][1 + page_id % 16], '?', 1), '#', 1)), chr(92), '/')) AS path
    FROM pages),
  cut AS (SELECT page_id, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM paths)"""
MARKERS = "[" + ", ".join(map(_text, V.SUSPICIOUS_SEGMENTS)) + "]"
SUSPICIOUS = f"""{PAGE_PATHS} SELECT page_id,
    len(list_filter(segments, lambda s: list_contains({MARKERS}, s)
        OR len(list_filter({MARKERS}, lambda m: starts_with(s, m || '.'))) > 0)) > 0
    OR contains('/' || array_to_string(segments, '/') || '/', '/admin/config/') AS is_probe
  FROM cut"""

# --- redaction of free text ----------------------------------------------------------------------

SECRETS = (
    rf"(?i)\b({V.SECRET_KEYS})\b(\s*[=:]\s*)(?:\"[^\"]*\"|'[^']*'|[^\s&;,\"']+)".replace('\\"', '"')
)


def replaced(pattern: str, replacement: str, text: str = "text", options: str = "g") -> str:
    return f"regexp_replace({text}, {_text(pattern)}, {_text(replacement)}, '{options}')"


_V4 = rf"(^|[^0-9A-Za-z.:])({V.OCTET}\.{V.OCTET}\.{V.OCTET})\.{V.OCTET}($|[^0-9A-Za-z.])"
# A neighbour can only serve one match at a time, hence the second round.
IPV4 = replaced(_V4, r"\1\2.0\3", replaced(_V4, r"\1\2.0\3"))

IPV6 = """SELECT event_id, CASE event_id % 6
    WHEN 0 THEN 'from ' || v6 || ' ok'
    WHEN 1 THEN '[' || v6 || ']:443'
    WHEN 2 THEN 'fe80::, 2001:db8::'
    WHEN 3 THEN '::ffff:192.' || (event_id % 256) || '.' || (user_id % 256) || '.0'
    WHEN 4 THEN '::ffff:192.168.' || ((256 + event_id % 60000) // 256) || '.0'
    ELSE 'at 13:55:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ' x' END AS text
  FROM (SELECT *, CASE WHEN user_id % 65536 = 0 THEN '2001:db8::'
    ELSE '2001:db8:' || lower(to_hex(user_id % 65536)) || '::' END AS v6 FROM events)"""

MASKED = f"""{MIXED}, masked AS (
    SELECT r.event_id, r.format,
      CASE WHEN r.ip IS NOT NULL THEN {MASKED_IP} END AS ip, {MASKED_URL.replace('url', 'r.url')} AS url
    FROM records r JOIN parts p ON r.event_id = p.event_id)"""

ORACLES = {
    "error_rates": f"""WITH {PARTS} SELECT (status // 100) || 'xx' AS status_class, count(*) AS n,
        CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM parts) AS DOUBLE) * 100 AS percent
        FROM parts GROUP BY 1""",
    **{f"extract_{layout}": one_layout(layout) for layout in KINDS},
    "extract_mixed": mixed("SELECT * EXCLUDE (is_probe) FROM records"),
    "csv_rows": mixed("SELECT " + ", ".join(
        f'{c} AS "{h}"' for c, h in zip(V.CSV_COLUMNS, V.CSV_HEADERS)) + " FROM records"),
    "rejected_lines": f"WITH {PARTS} SELECT event_id, {REJECTED_PLAIN} AS line FROM parts WHERE kind = 10",
    "timestamps_utc": stamps(False),
    "timestamps_assumed": stamps(True),
    "timestamps_yearless": YEARLESS,
    "timestamps_passthrough": PASSTHROUGH,
    "duration_ms": f"""WITH {PARTS} SELECT event_id, CASE WHEN event_id % 4 < 2 THEN value_ms
        WHEN event_id % 4 = 2 THEN took_ms END AS duration_ms FROM parts""",
    "status_code": f"WITH {PARTS} SELECT event_id, CASE WHEN event_id % 4 < 2 THEN status END AS status FROM parts",
    "request_split": f"""WITH {PARTS} SELECT event_id, CASE WHEN event_id % 4 < 2 THEN method END AS method,
        CASE event_id % 4 WHEN 2 THEN lower(method) || ' ' || url WHEN 3 THEN method || ' ' || url || ' a b'
        ELSE url END AS url FROM parts""",
    "status_class": f"WITH {PARTS} SELECT event_id, (status // 100) || 'xx' AS status_class FROM parts",
    "path_segments": f"{PAGE_PATHS} SELECT page_id, array_to_string(segments, '|') AS segments FROM cut",
    "suspicious_urls": SUSPICIOUS,
    "format_counts": mixed(tally("format")),
    "status_counts": mixed(tally("status_class")),
    "level_counts": mixed(tally("level")),
    "top_ips": mixed(tally("ip")),
    "top_urls": mixed(tally("url")),
    "top_probe_ips": mixed(tally("probe_ip")),
    "top_probe_paths": mixed(tally("probe_path")),
    "probe_hits": mixed(tally("probe_hit")),
    "broken_links": mixed(tally("broken_link")),
    "format_profile": mixed(
        "SELECT 'log-' || (event_id % 3) AS file, format, count(*) AS n FROM records GROUP BY 1, 2"),
    "summary_tallies": mixed(" UNION ALL ".join(
        f"SELECT '{name}' AS tally, * FROM ({tally(name)})" for name in TALLIES)),
    "approx_tallies": mixed(" UNION ALL ".join(
        f"SELECT '{name}' AS tally, * FROM ({tally(name)})" for name in ("format", "status_class", "level"))),
    "approx_bounds": "SELECT true AS holds",
    "top_2000_urls": mixed(tally("url").replace("rank <= 10", "rank <= 2000")),
    "traffic_totals": mixed(TOTALS),
    "report_tallies": mixed(" UNION ALL ".join(
        f"SELECT '{name}' AS tally, *, true AS exact FROM ({tally(name)})" for name in TALLIES)),
    "report_scalars": mixed(f"SELECT *, unique_ips AS unique_ips_low, unique_ips AS unique_ips_high FROM ({TOTALS})"),
    "approx_totals": mixed(f"SELECT {', '.join(EXACT_TOTALS)}, false AS percentiles_exact FROM ({TOTALS})"),
    "latency_percentiles": mixed(
        f"SELECT {PERCENTILE.format(f=0.5)} AS p50_ms, {PERCENTILE.format(f=0.95)} AS p95_ms"),
    "redact_secrets": f"SELECT doc_id, {replaced(SECRETS, chr(92) + '1' + chr(92) + '2***')} AS text FROM documents",
    "redact_auth": "SELECT doc_id, " + replaced(
        r"(?i)\b(Bearer|Basic|Digest)\s+[A-Za-z0-9._~+/=-]{8,}", r"\1 ***",
        "(text || ' by Bearer abcdefgh' || doc_id)") + " AS text FROM documents",
    "redact_email": "SELECT doc_id, " + replaced(
        r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", r"***@\1") + " AS text FROM documents",
    "redact_ipv4": f"SELECT doc_id, {IPV4} AS text FROM documents",
    "redact_ipv6": IPV6,
    "redact_all_records": f"""{MASKED}
      SELECT event_id, format, ip, url, CAST(NULL AS VARCHAR) AS line FROM masked
      UNION ALL SELECT event_id, NULL, NULL, NULL, {REJECTED_MASKED} FROM parts WHERE kind = 10""",
    "redacted_top_ips": f"{MASKED} {tally('ip', 'masked')}",
}
