"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Uses the folder named in spark.checkpoint.dir; where none is named, one under the warehouse."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def written(df: DataFrame) -> DataFrame:
    ready(df.sparkSession)
    return df.checkpoint()
