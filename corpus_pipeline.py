"""From raw documents to a training mix: five operators of the library in a row.

Every stage takes the rows its predecessor kept and returns the columns of
``documents``; the last adds the number of the copy and its place in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.llm.decontaminate import drop_contaminated
from logspark.llm.mixing import mix
from logspark.llm.pii import redact
from logspark.llm.quality import keep_good
from logspark.llm.shared import landed_apart
from logspark.llm.simhash import keep_one


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("personal_data", _personal_data),
    ("mixing", _mixing),
]

#: No SQL: the trained stages cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; what each returns is written and read again.

    The tables that a stage writes on its way are deleted when its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = landed_apart(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
