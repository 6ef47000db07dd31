"""Every query of the library by name, with the SQL it is held against where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.dialects import Duck, Spark
from .plans import evaluation, graph, ledger, measures, retrieval, search

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = ledger.QUERIES | graph.QUERIES | retrieval.QUERIES | evaluation.QUERIES


def run_plan(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a plan over the tables it names; they are views for the time of analysis only."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    try:
        return spark.sql(sql)
    finally:
        for t in used:
            spark.catalog.dropTempView(t)


def query(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_plan(spark, sf_dir, plan(Spark()))


#: What operators express is their own; only the SQL that it is held against comes from plans.
QUERIES = {name: query(plan) for name, plan in PLANS.items()} | search.QUERIES | measures.QUERIES
ORACLES = {name: plan(Duck()) for name, plan in PLANS.items()} | measures.ORACLES
