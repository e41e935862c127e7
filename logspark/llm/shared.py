"""Tables written to the shared folder, and column names that clash with nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.sources.versions import delete

_OWN: dict[str, str] = {}
#: Folders below which new ones are made, the innermost last.
_SCRATCH: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine gets a temporary folder of its own
    and a cluster the warehouse, which all its machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        _OWN[app] = tempfile.mkdtemp(prefix="llm-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder, or the scratch folder in use, that nothing has used before."""
    base = _SCRATCH[-1] if _SCRATCH else shared_folder(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside the block are deleted at its end; what is read later has to be landed outside."""
    folder = new_folder(spark, "scratch")
    _SCRATCH.append(folder)
    try:
        yield
    finally:
        _SCRATCH.remove(folder)
        delete(spark, folder)


def landed_apart(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, landed; the tables that it landed on the way are deleted."""
    path = new_folder(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    It cuts the lineage, survives lost executors, and gives the optimizer the
    table's true size, so a join on it is broadcast only below Spark's threshold.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made from ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def unit_hash(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of ``seed`` and ``parts``, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
