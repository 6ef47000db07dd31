"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept: documents that fail the quality
rules go; one document of each near-duplicate class (five-word shingles, 0.8) stays; byte strings that an earlier document
holds go; secrets that look live give way to a mask; what is left is tokenised and packed. All but the last return the
columns of documents, with n_chars of the text that is left.

Defined cases: a null text counts as empty: the rules reject it, and the other stages keep it (suffix_dedup as an empty text, with n_chars 0);
a null id stands after all others; repeated rows are judged alike, and near_dedup leaves one of them; ties of the rules' ratio
with its threshold are kept; texts of any length go whole through every stage; extra columns pass through,
whatever their names, as far as the last stage; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import checkpoint, table
from ledgerlens.llm.near_dedup import one_of_each
from ledgerlens.llm.packing import pack
from ledgerlens.llm.quality_rules import kept_documents
from ledgerlens.llm.secret_scan import mask
from ledgerlens.llm.suffix_dedup import without_repeats


def with_size(docs: DataFrame) -> DataFrame:
    """n_chars of the changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_size(without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_size(mask(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: Hashes, tokenizers and window passes have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
