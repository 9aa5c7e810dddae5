"""The corpus pipeline: toxicity, quality rules, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; run() writes what each returns as Parquet in the
shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, packing, quality_rules, simhash, toxicity
from gristmill.llm.common import materialise, release, written_so_far
from gristmill.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_good), ("simhash_near_dedup", one_of_each), ("benchmark_decontamination", drop_contaminated), ("best_fit_packing", pack)]

#: No SQL: a conditional random field and a tokenizer stand in the way; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    mark = written_so_far(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, mark)  # the stage's input and all that it wrote on its way
    return docs
