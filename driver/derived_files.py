"""The mixed lines as log files: plain, gzipped, and gzipped without a name that says so."""

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver import derived_lines as D
from logspark.plans.once import work_directory
from logspark.sources.versions import file_system

#: Lines of a file; how a file is written goes by its number.
FILE_LINES = 2000
KINDS = ("plain", "packed", "hidden")


def work(spark: SparkSession) -> str:
    """A new path in the shared folder; in a local session without one, in a folder deleted at its end."""
    fallback = None
    master = spark.sparkContext.master
    if spark.conf.get("spark.checkpoint.dir", None) is None and master.startswith("local") and "cluster" not in master:
        fallback = tempfile.mkdtemp(prefix="logspark-")
        atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    return work_directory(spark, fallback)


def write_files(lines: DataFrame, at: str, packed: bool = False) -> None:
    """``(file, pos, line)`` as one text file for every number, in order, below ``at/file=<number>``."""
    dealt = lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "line")
    dealt.write.partitionBy("file").option("compression", "gzip" if packed else "none").text(at)


def log_files(spark: SparkSession, sf_dir: str) -> str:
    """A pattern of all the files."""
    at = work(spark)
    lines = D.mixed_lines(spark, sf_dir).withColumn("file", F.floor(F.col("pos") / FILE_LINES))
    kind = F.col("file") % len(KINDS)
    write_files(lines.where(kind == KINDS.index("plain")), f"{at}/plain")
    write_files(lines.where(kind != KINDS.index("plain")), f"{at}/packed", True)
    fs, to_path = file_system(spark, at)
    for status in fs.globStatus(to_path(f"{at}/packed/*/*.gz")) or []:
        name = status.getPath().toString()
        number = int(name.rsplit("/file=", 1)[1].split("/")[0])
        if number % len(KINDS) == KINDS.index("hidden") and not fs.rename(to_path(name), to_path(name.removesuffix(".gz"))):
            raise OSError(f"could not rename {name}")
    return f"{at}/*/*/part-*"


def file_number(column: str = "file"):
    return F.regexp_extract(column, "/file=([0-9]+)/", 1).cast("long")
