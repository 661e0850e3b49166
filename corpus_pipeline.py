"""A corpus in five stages: language, toxicity, near-duplicates, benchmark passages, tokens.

Each stage takes what its predecessor kept and returns it less what it rejects, with the
columns of ``documents``; the last one returns the tokens' digest. ``run`` writes each
stage's rows to the shared folder and reads them again, so a lost executor costs one
stage's tasks at most. Extra columns stay with their values, whatever their names; repeated
rows and ties are decided as each stage says, very long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalens.llm import bpe, decontaminate, langid, queries, simhash, toxicity
from stratalens.llm.common import free_name, held_out, table
from stratalens.session import own_dir

MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that a learned language claims with a score of one half or more. Null
    texts and texts without a letter go."""
    prefix = free_name(docs.columns, "said_")
    lang, score = F.col(f"{prefix}lang"), F.col(f"{prefix}score")
    model = langid.fit(docs.where(~held_out()))
    found = langid.predict(docs, model, lang_pred=f"{prefix}lang", score=f"{prefix}score")
    return found.where((lang != "und") & (score >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that score below the threshold; null and empty ones stay."""
    score = free_name(docs.columns, "said_") + "score"
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.predict(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (``simhash.one_of_each``): the smallest id, a null id
    last. Null and empty texts are one group."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes contaminated documents; null and empty ones stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left; a null text has no ids."""
    return queries.bpe_digest(bpe.encode_decode(docs, queries.tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encode_decode", tokens),
]

ORACLE_SQL = None  # learned models and tokens have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
