"""Corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing, over the table ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.  Null ids, null and empty texts pass through (an id that is null cannot be dropped by
name); extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.near_texts import near_texts
from wattline.llm.packing import pack_documents
from wattline.llm.quality import fit_ranker, labelled_sample, score_texts, text_features
from wattline.llm.queries import WORD_BPE, tokenizer
from wattline.llm.repeats import remove_repeats
from wattline.llm.secrets import find_secrets
from wattline.session import discard, stored, tune

# share of the labelled good documents that may lie below the least score that is kept
LOST_SHARE = 0.005


def _apart(docs: DataFrame) -> DataFrame:
    """Columns numbered, but for the two that operators read, so that no result has the name of a column."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)])


def _back(done: DataFrame, docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again; where ``changed``, with the new text and its number of characters."""
    out = {c: F.col(c if c in ("doc_id", "text") else f"`column {i}`") for i, c in enumerate(docs.columns)}
    if changed is not None:
        for c, new in (("text", text), ("n_chars", F.length(text).cast("long"))):
            if c in out:
                out[c] = F.when(changed, new).otherwise(out[c])
    return done.select(*[out[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below the quantile ``LOST_SHARE`` of the labelled good ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    tune(spark)
    ranker = fit_ranker(text_features(labelled_sample(docs, labels)), labels)
    return _back(score_texts(_apart(docs), ranker).where(F.col("score") >= ranker.threshold(LOST_SHARE)), docs)


# least Jaccard similarity, in percent, of the five-word shingles of near-duplicates: the task's value for stages
NEAR_PERCENT = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = NEAR_PERCENT) -> DataFrame:
    """Keeps one document of each component of near-duplicates, texts that share at least ``percent`` of their five-word
    shingles; an id on several rows goes only if all of them do, and equal texts under one id stay once."""
    tune(spark)
    found = near_texts(docs, percent=percent).where("doc_id IS NOT NULL")
    per_id = stored(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times")))
    gone = per_id.where("NOT kept").select("doc_id")
    again = per_id.where("kept AND times > 1").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(gone.union(again), "doc_id", "left_anti").select(*docs.columns)
    return single.union(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of windows that occur more than once; other texts stay as they are."""
    tune(spark)
    return _back(remove_repeats(_apart(docs)), docs, F.col("n_removed") > 0, F.col("kept_text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret."""
    tune(spark)
    return _back(find_secrets(_apart(docs)), docs, F.col("masked").isNotNull(), F.col("masked"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    tune(spark)
    return pack_documents(docs, tokenizer(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("secrets", secrets), ("packing", packing),
]

# learnt scores and hashing have no SQL; tests/llm/test_pipeline.py goes through it by brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)  # the table of the stage before is read no more; the input is not a stored one
    return STAGES[-1][1](spark, docs, sf_dir)
