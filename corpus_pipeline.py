"""A corpus pipeline: five stages, each one operator, over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents, whatever their names. Null ids, null and empty texts, repeated rows and empty
tables go through as each operator says in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.decontam import decontaminate
from brindle.llm.mixing import order_mix, plan_mix
from brindle.llm.near_dedup import keep_one
from brindle.llm.runtime import stored, unused
from brindle.llm.token_files import read_tokens, tokenizer_file, write_tokens
from brindle.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80% of its 5-word shingles."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order; empty ones have no words to take."""
    plan, position = plan_mix(docs, keep=docs.columns), unused("position", docs.columns)
    taken = plan.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns), F.explode("positions").alias(position))
    return order_mix(taken, position_col=position).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, tokenizer_file()), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Stage 1 is a classifier, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
