"""A corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns the rows that it keeps; all but the last keep the columns of
documents. Side tables (labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm import bpe_codec, decontaminate, name_filter, quality_knn, simhash, storage, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _apart(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and all others as a struct ``rest``, which an operator can't take for its own."""
    return docs.select(*own, F.struct(*[storage.quoted(c) for c in docs.columns if c not in own]).alias("rest"))


def _together(made: DataFrame, docs: DataFrame, **own: Column) -> DataFrame:
    """The columns of ``docs``: those named in ``own`` as they are given, the others out of ``rest``."""
    return made.select(*[own[c].alias(c) if c in own else F.col("rest").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; blank texts score like the labelled sample and mostly stay.

    Every row is judged, repeated or without doc_id; all columns stay as they are, whatever their names. Without any label,
    nothing is rejected. An empty table gives an empty one.
    """
    model = quality_knn.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    made = quality_knn.score(_apart(docs, "text"), model).where("predicted = 1")
    return _together(made, docs, text=F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts alike over five-word shingles.

    Rows without doc_id are judged like others and stay only where no alike row has one. Rows that share an id are told
    apart by their texts. All blank texts are one group.
    """
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that an earlier place has; others as they are.

    n_chars follows a text that changes, where it is a column. A null text stays null.
    """
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    cut = substring_dedup.remove_repeats(_apart(docs, *own), texts=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    made = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in own:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _together(cut, docs, **made)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; rows are told by id and text, so those without an id go, too."""
    rows = name_filter.keyed(docs).select(F.struct("id", "same").alias("doc_id"), F.col("row.text").alias("text"))
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return name_filter.without(docs, storage.written(found.select("doc_id.*").distinct(), "contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left and the text decoded from them, with their digests; a null text has no ids."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), texts=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("decontamination", decontamination), ("tokens", tokens)]
#: No stage but the first and the last but one could be told in SQL on whole tables; the tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{storage.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
