"""The expected results of the queries over files, from the tables' own columns."""

from driver import oracle_set as O
from driver.derived_files import FILE_LINES, KINDS
from driver.query_set import EXACT_TOTALS
from logspark import fixed_values as V

NUMBERED = f"""numbered AS (
    SELECT event_id, event_id // {FILE_LINES} AS file,
      row_number() OVER (PARTITION BY event_id // {FILE_LINES} ORDER BY event_id) AS lineno FROM events)"""
CSV = ", ".join(f'CAST({c} AS VARCHAR) AS "{h}"' for c, h in zip(V.CSV_COLUMNS, V.CSV_HEADERS))
ALL_TALLIES = " UNION ALL ".join(f"SELECT '{name}' AS tally, *, true AS exact FROM ({O.tally(name)})" for name in O.TALLIES)
KEYS = " UNION ALL ".join(
    f"SELECT '{name}' AS tally, least(10, count(DISTINCT {key})) AS named, true AS holds FROM records WHERE {where} HAVING count(*) > 0"
    for name, (where, key) in O.TALLIES.items() if name not in ("format", "status_class", "level"))
PIPED = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, CAST(NULL AS VARCHAR) AS tz,
    CAST(NULL AS VARCHAR) AS level, CASE WHEN is_v6 THEN v6 ELSE v4 END AS ip, method, url, status, took_ms AS duration_ms,
    CAST(NULL AS VARCHAR) AS bytes, 'pipes' AS format FROM parts WHERE event_id % 10 <> 0"""
STEPS = {"before": "NULL", "first written": "NULL", "first published": "count(*) FILTER (event_id % 2 = 0)",
         "second written": "count(*) FILTER (event_id % 2 = 0)", "second published": "count(*)", "third failed": "count(*)"}

ORACLES = {
    "job_records": f"""{O.MIXED}, {NUMBERED}
      SELECT n.file, n.lineno, {', '.join('r.' + c for c in V.CSV_COLUMNS)}
      FROM records r JOIN numbered n ON n.event_id = r.event_id""",
    "job_rejected": f"""WITH {O.PARTS}, {NUMBERED}
      SELECT 'line ' || lineno || ': ' || line AS line FROM (
        SELECT event_id, {O.REJECTED_PLAIN} AS line FROM parts WHERE kind = 10) JOIN numbered USING (event_id)""",
    "job_csv": O.mixed(f"SELECT {CSV} FROM records"),
    "job_csv_gzip": O.mixed(f"SELECT {CSV} FROM records"),
    "job_scalars": O.mixed(f"SELECT *, unique_ips AS unique_ips_low, unique_ips AS unique_ips_high FROM ({O.TOTALS})"),
    "job_estimates": O.mixed(f"SELECT {', '.join(EXACT_TOTALS)}, false AS percentiles_exact FROM ({O.TOTALS})"),
    "hidden_gzip": f"""SELECT event_id // {FILE_LINES} AS file, count(*) AS lines FROM events
      WHERE event_id // {FILE_LINES} % {len(KINDS)} = {KINDS.index('hidden')} GROUP BY 1""",
    "csv_line_feeds": """SELECT '/a' || [chr(10), '"', ',', chr(13) || chr(10)][1 + event_id % 4] || 'b/' || event_id AS url,
      '200' AS status FROM events""",
    "versioned_output": " UNION ALL ".join(
        f"SELECT '{s}' AS step, CAST(NULL AS BIGINT) AS n" if n == "NULL" else f"SELECT '{s}', {n} FROM events" for s, n in STEPS.items()),
    "file_years": "SELECT event_id, true AS fits FROM events",
    "own_layout": f"WITH {O.PARTS} {PIPED}",
    "redact_keep": f"""{O.MIXED}
      SELECT event_id, format, ip, url, CAST(NULL AS VARCHAR) AS line FROM records
      UNION ALL SELECT event_id, NULL, NULL, NULL, {O.REJECTED_PLAIN} FROM parts WHERE kind = 10""",
    "two_pass_tallies": O.mixed(ALL_TALLIES),
    "top_urls_two_pass": O.mixed(" UNION ALL ".join(
        f"SELECT '{name}' AS tally, * FROM ({O.tally(name)}) WHERE rank <= 4" for name in ("url", "probe_path"))),
    "latency_percentiles_refined": O.mixed(
        f"SELECT {O.PERCENTILE.format(f=0.5)} AS p50_ms, {O.PERCENTILE.format(f=0.95)} AS p95_ms"),
    "distinct_ips": O.mixed("""SELECT count(DISTINCT ip) FILTER (NOT contains(ip, ':')) AS ipv4,
      count(DISTINCT ip) FILTER (contains(ip, ':')) AS other, count(DISTINCT ip) AS unique_ips FROM records"""),
    "merged_totals": O.mixed(f"""SELECT 3 AS files, parsed, skipped, timed, mean_ms, rate_4xx, rate_5xx, probe_attempts,
      probe_successes, unique_ips AS exact_ips, true AS holds FROM ({O.TOTALS})"""),
    "merged_percentiles": O.mixed("""SELECT name, (SELECT count(duration_ms) FROM records) AS timed, true AS holds
      FROM (VALUES ('p50_ms'), ('p95_ms')) t(name)"""),
    "merged_top_keys": O.mixed(KEYS),
}
