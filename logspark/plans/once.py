"""Keep filters from re-evaluating the projections below them, and plans from running twice."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """Stop later filters from being pushed below the columns computed so far.

    The optimizer moves a filter under a projection by copying the projected
    expressions into it, so a filter on a parsed field would run the line
    regexes twice per row, and once more for every further reference. Filters
    stay above a projection that is not deterministic; column pruning still
    passes through it.
    """
    return (
        df.select(*df.columns, F.spark_partition_id().alias("_partition"))
        .where("_partition >= 0")
        .select(*df.columns)
    )


def work_directory(spark: SparkSession, fallback: str | None = None) -> str:
    """A new path in the cluster's shared folder; ``fallback`` only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not base:
        raise ValueError("set spark.checkpoint.dir or pass work_dir: a folder all executors can reach")
    return f"{base.rstrip('/')}/logspark-{uuid.uuid4().hex}"


def landed_at(df: DataFrame, name: str, work: str | None = None) -> DataFrame:
    """``df`` as a written table, which is read as often as needed and survives lost executors."""
    path = f"{work.rstrip('/')}/{name}-{uuid.uuid4().hex}" if work else f"{work_directory(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
