"""A corpus pipeline of the training-data operators; each stage's rows are written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partmill.llm import decontaminate, language_id, mixing, ngram_join, queries, tables, token_store
from partmill.sources.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; ``lang`` is kept where it is known and else filled with the prediction."""
    tables.prepare(spark)
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out()))
    found = tables.free_name(docs, "_language")
    known = docs.withColumn(found, language_id.language_of(F.col("text"), profiles)).where(F.col(f"{found}.lang") != language_id.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", f"{found}.lang")).select(tables.columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that with the smallest id."""
    tables.prepare(spark)
    return ngram_join.keep_one_per_class(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    return decontaminate.drop_leaks(docs, tables.benchmark(spark, sf_dir))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that source, language and topic shares are flattened."""
    tables.prepare(spark)
    return mixing.keep_sampled(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token shards written for what is left."""
    tables.prepare(spark)
    return token_store.read_token_digests(token_store.write_token_shards(docs, queries.tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_targets),
    ("token_output", write_tokens),
]

#: MinHash, alignment, raking and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
