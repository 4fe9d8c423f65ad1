"""Corpus pipeline: five of the llm operators, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

1. quality: documents that fail a rule of policy v1 go.
2. near_duplicates: of each group of near copies the row of smallest id stays.
3. decontamination: documents that hold benchmark passages go.
4. mixing: sources are taken by weight; documents repeat or go accordingly, and
   stand in the order of the schedule in each file.
5. token_binary: the mix is written as token ids and described from its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlake.llm.decontaminate import clean_documents
from threadlake.llm.jaccard import one_of_each
from threadlake.llm.mixing import mixed_documents
from threadlake.llm.quality import filter_documents
from threadlake.llm.token_ids import binary_corpus
from threadlake.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Executors hold the heap of the stages before: a fifth of the usual memory for words.
    return binary_corpus(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=300_000)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_binary", token_binary),
]

#: The mix draws on seeded hashes and the last stage on a tokenizer, which SQL
#: does not have; test_run_against_plain in tests/llm/test_pipeline.py compares
#: every stage, and run(), with plain Python on a small planted corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
