"""A training-corpus pipeline over the documents table: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of docs, the last
one its report. Decisions are keyed by a hash of id and text, so that null or repeated ids cannot
take another document's fate; equal rows share theirs. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import decontaminate, mixing, token_parquet, toxicity
from seqspark.llm import near_copies as similar
from seqspark.llm.common import cut, table

KEY = "__key"


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose key is in rejected(doc_id)."""
    keys = cut(rejected.select(F.col("doc_id").alias(KEY)).distinct(), "rejected")
    return docs.withColumn(KEY, _key()).join(keys, KEY, "left_anti").drop(KEY)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = toxicity.Model(docs, table(spark, sf_dir, "labels"))
    return _without(docs, model.score(docs.select(_key().alias("doc_id"), "text")).where("score >= 0.5"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard of five-word shingles 0.8 or more, verified) the document
    with the smallest id stays; null ids come last.

    Two texts under one id are two documents; the key parts documents that tie on the id."""
    marked = docs.withColumn(KEY, _key())
    groups = similar.near_copies(marked.select(F.col(KEY).alias("key"), "text")).withColumnRenamed("key", KEY)
    members = marked.select(KEY, "doc_id").distinct().join(groups, KEY)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", KEY)
    kept = cut(members.groupBy("component_id").agg(F.min(rank)[KEY].alias(KEY)).select(KEY), "kept")
    # Rows equal in id and text may differ elsewhere: the least of their other columns stays, in every run.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = marked.join(kept, KEY, "left_semi").groupBy(KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), *([F.min(F.struct(*rest)).alias("__rest")] if rest else []))
    return same.select(*(F.col(f"__rest.{c}").alias(c) if c in rest else c for c in docs.columns))


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.leaks(docs.select(_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, reported per document: doc_id, start, n_tokens, ids_crc32."""
    return token_parquet.round_trip(docs)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("decontamination", leaked), ("mixing", mixed), ("tokens", tokens)]
#: SQL has no tokenizer and no boosted trees; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
