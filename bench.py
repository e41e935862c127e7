"""Time the headline queries; prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. ``value`` is
the total of all queries. ``lines_per_second`` is the full job's rate (text
files in, columnar records and report out) over a larger file of lines, the
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import logspark as ls  # noqa: E402
from driver.derived_lines import mixed_lines  # noqa: E402
from driver.file_queries import QUERIES as FILE_QUERIES  # noqa: E402
from driver.query_set import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
COPIES = int(os.environ.get("BENCH_COPIES", "20"))


def full_job(spark, work):
    """Lines per second from text files to landed records and both reports."""
    source = os.path.join(work, "lines")
    copies = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    mixed_lines(spark, SF_DIR).select("line", copies).select("line").repartition(int(CPUS)).write.text(source)
    lines = spark.read.text(source).count()
    best = 0.0
    for _ in range(2):
        start = time.time()
        result = ls.run_job(spark, source, work_dir=os.path.join(work, "landed"))
        result.tallies.collect()
        result.scalars.collect()
        best = max(best, lines / (time.time() - start))
        result.close()
    return lines, best


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["extract_mixed"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in {**QUERIES, **FILE_QUERIES}.items():
        start = time.time()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    with tempfile.TemporaryDirectory(prefix="bench-") as work:
        lines, rate = full_job(spark, work)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "lines_per_second": round(rate), "job_lines": lines, "baseline_lines_per_second": 26000,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
