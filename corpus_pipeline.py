"""A corpus pipeline of four stages over ``documents``: toxic documents go, near duplicates
go but for one of each group, sources are mixed to their target weights, and what is left
is encoded and decoded by byte-level BPE.

Each stage is written to Parquet and read back as the next one's input. Rejection by
toxicity takes a score of at least 0.5. SQL cannot express the stages, so there is no
``ORACLE_SQL``; a test holds the rows of ``run`` against plain Python versions of the near
duplicates, the mix and the encoding, with the fitted toxicity model applied text by text.

Defined cases are those of the operators: null texts are empty, repeated rows are one document after the
second stage, an empty table gives an empty result, and other columns pass through up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import byte_bpe, mixing, near_dedup, toxicity
from weirflow.llm.queries import split_pattern, tokenizer_file
from weirflow.plans.runtime import ROW_GROUP, checkpoint_dir, sparing, table

TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, model, "__toxic_score")
    return scored.where(scored["__toxic_score"] < TOXIC_SCORE).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("source mixing", mix_sources), ("byte-level BPE", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with sparing(spark):
            out.write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
