"""Quality classifier by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words (lower-cased, by hash in a bounded number of buckets), the three-letter sequences of its
shape (every byte is one of twelve classes: lower case, upper case, digit, white space, kinds of punctuation and so on)
and a few terms for repeated words. Term weights are the root of the counts times an inverse document frequency, and a
truncated singular value decomposition of the labelled sample gives the latent space. The labelled vectors are broadcast, at most ``SAMPLE`` of them; every document's
cosine to every labelled vector is computed, in blocks, and the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tablewright.llm.storage import as_rows, bound_batches, fields, lean, pieces
from tablewright.llm.words import word_hashes

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 4000
DIMENSIONS, NEIGHBOURS = 48, 25
CLASSES = 12
REPEATS = 8  # terms for repeated words
#: Buckets of words, and the share that words have in a text's counts next to its shape.
WORDS, WORD_SHARE = 1024, 0.02
TERMS = CLASSES**3 + REPEATS + WORDS


def _class_table() -> np.ndarray:
    table = np.full(256, 10, np.int64)
    table[:32] = 11
    for chars, k in ((b" \t", 0), (b"\n\r", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (b".,;:", 6), (b"!?", 7), (b"|", 8), (b"#$%&*~^@", 9)):
        table[list(chars)] = k
    table[128:] = 5
    return table


SHAPES = _class_table()


def term_counts(texts: pa.Array) -> np.ndarray:
    """Relative counts of each text's terms, a row for each text; a text without terms has zeros."""
    raw = texts.fill_null("").cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(raw), TERMS), np.float32)
    words, starts = word_hashes(texts, lower=True)
    buckets = (words % np.uint64(WORDS)).astype(np.int64)
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if e - s >= 3:
            shape = SHAPES[data[s:e]]
            codes = shape[:-2] * CLASSES**2 + shape[1:-1] * CLASSES + shape[2:]
            out[i, : CLASSES**3] = np.bincount(codes, minlength=CLASSES**3) / (e - s)
        own = words[starts[i] : starts[i + 1]]
        n = len(own)
        if n:
            again = 1 - len(np.unique(own)) / n
            twice = np.mean(own[1:] == own[:-1]) if n > 1 else 0.0
            pairs = own[1:] ^ (own[:-1] << np.uint64(1))
            same = 1 - len(np.unique(pairs)) / max(1, len(pairs))
            flags = [again > 0.5, again > 0.7, again > 0.85, twice > 0.05, twice > 0.3, same > 0.15, same > 0.4, same > 0.7]
            out[i, CLASSES**3 : CLASSES**3 + REPEATS] = np.array(flags) * 0.05
            out[i, CLASSES**3 + REPEATS :] = np.bincount(buckets[starts[i] : starts[i + 1]], minlength=WORDS) * (WORD_SHARE / n)
    return out


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Term weights, the latent space, and the labelled vectors (unit length) with their labels."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = _weights(counts, self.idf) @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The vote of each text's nearest labelled vectors, weighted by the eighth power of the cosine.

        Cosines are rounded to five digits; of equal ones the vector that comes first counts as nearer. How texts are
        batched may change a score in its fifth digit.
        """
        n = len(self.vectors)
        if not n:
            return np.full(len(counts), 0.5)
        k = min(neighbours, n)
        near = np.rint(self.project(counts) @ self.vectors.T * 1e5).astype(np.int64)
        order = near * n + np.arange(n - 1, -1, -1)
        index = np.argpartition(order, n - k, axis=1)[:, n - k :]
        weight = np.maximum(np.take_along_axis(near, index, axis=1) / 1e5, 0) ** 8
        total = weight.sum(axis=1)
        mean = float(self.labels.mean())
        vote = (weight * self.labels[index]).sum(axis=1)
        return np.clip(np.where(total > 1e-9, vote / np.maximum(total, 1e-9), mean), 0, 1).astype(np.float64)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Latent space by randomised subspace iteration on the weighted sample."""
    n, terms = counts.shape
    idf = np.log((n + 1) / ((counts > 0).sum(axis=0) + 1)).astype(np.float32) + 1
    x = _weights(counts, idf)
    width = min(dimensions + 8, n, terms)
    basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32)))[0] if n else np.zeros((terms, 0), np.float32)
    for _ in range(4 if n else 0):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    if n:
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        basis = basis @ turn.T[:, :dimensions]
    model = Model(idf, basis.astype(np.float32), np.zeros((0, basis.shape[1]), np.float32), labels.astype(np.float32))
    model.vectors = model.project(counts)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out, those with the smallest id hashes.

    Labels without a doc_id, or other than 0 and 1, are left out; of several labels of one id the larger counts, of
    several texts of one id the first in byte order. So the driver gets at most ``sample`` rows of term counts, whatever
    rows repeat an id and however long a text is. Ids may be of any type that joins. Without any labelled row the model
    is empty.
    """
    bound_batches(docs.sparkSession)
    told = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = pa.array(batch.column("text").to_pylist(), pa.string())
            counts = term_counts(texts)
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in counts], pa.binary())], names=["id", "label", "terms"])

    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = met.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("label").cast("int").alias("label"), F.min("text").alias("text"))
    rows = one.mapInArrow(lean(run), "id string, label int, terms binary").toArrow()
    rows = rows.sort_by("id").combine_chunks()
    counts = np.stack([np.frombuffer(x, np.float32) for x in rows["terms"].to_pylist()]) if len(rows) else np.zeros((0, TERMS), np.float32)
    return fit(counts, rows["label"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1: the neighbours' vote for label 1) and predicted (1 from 0.5 on).

    A null or empty text has no neighbour and scores the labelled sample's mean; without any labelled row every score
    is 0.5. Every row gives a row, repeated or not, whatever its doc_id and the length of its text. Columns of ``docs``
    named score or predicted are replaced, others kept whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(fields(batches)):
            texts = pa.array(batch.column("text").to_pylist(), pa.string())
            found = model.scores(term_counts(texts)) if len(texts) else np.zeros(0)
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    rows = docs.select(as_rows(docs, kept))
    return rows.mapInArrow(lean(run), StructType([*rows.schema["row"].dataType, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
