"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so that a sketch of two texts together is
the union of their sketches, and shares of common hashes estimate containment whatever the texts' lengths. Where no
hash of a text is below the threshold the smallest one is kept, so that only a text without words has an empty sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.storage import bound_batches, lean, pieces, width
from tablewright.llm.words import U64, sequence_hashes, word_hashes

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
BASE = 0x2545F4914F6CDD1D


def sketches(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted distinct kept hashes of each text. Fewer words than a shingle: the whole sequence is one."""
    words, starts = word_hashes(texts, lower=True)
    hashes = sequence_hashes(words, shingle, BASE)
    most = U64((1 << 64) // scale)
    out = []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = hashes[s : e - shingle + 1] if e - s >= shingle else sequence_hashes(words[s:e], e - s, BASE) if e > s else hashes[:0]
        kept = own[own < most]
        out.append(np.unique(kept) if len(kept) else own.min(keepdims=True) if len(own) else own)
    return out


def spelt(sketch: np.ndarray) -> str:
    """A sketch as text: 16 hex digits for each hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; of two empty sketches 1, of one 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    kept = both[both < U64((1 << 64) // scale)]
    return kept if len(kept) else both[:1]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points of the next document's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_neighbours(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every row of ``docs(doc_id, text)``, of its edited text, and their likeness.

    Documents are taken in ascending doc_id, nulls first, those of one id by a hash of their text; the last is followed
    by the first, and a single one by itself. Null text is empty. near_edited and near_next are the estimated
    containment of the document in its edited text and in the next document. Every row gives a row, repeated ones too;
    an empty table gives an empty result. Other columns are ignored.

    Rows are dealt by ranges of doc_id; an id that fills several ranges is split over them by the hash of the text. The
    first row of a range also goes to the end of the range before, so that every range knows the document that follows
    it. A range streams through its task, with one document held at a time.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("hash"), F.col("doc_id"), text.alias("text"))
    ranges = 4 * width(spark)
    found = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    points, times = (np.array(x, np.int64) for x in np.unique(np.array(found, np.int64), return_counts=True))
    before = np.concatenate([[0], 1 + np.cumsum(times) - times, [1 + times.sum()]])

    def places(keys: pd.Series, hashes: pd.Series) -> np.ndarray:
        """The range of each row, in order of (key, hash): a point of several ranges has a share of the hashes in each."""
        own, at = keys.to_numpy(np.int64), np.searchsorted(points, keys.to_numpy(np.int64), side="right")
        if not len(points):
            return at
        i = np.maximum(at - 1, 0)
        quarter = ((hashes.to_numpy(np.int64).view(U64) ^ U64(1 << 63)) >> U64(2)).astype(np.int64)
        part = np.where(own == points[i], quarter // ((1 << 62) // times[i] + 1), times[i] - 1)
        return np.where(at > 0, before[at] + part, 0)

    @F.pandas_udf("int")
    def place(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(places(keys, hashes).astype(np.int32))

    # The ranges' first rows, of which there are no more than ranges.
    heads = rows.select("key", "hash", place("key", "hash").alias("place")).groupBy("place").agg(F.min(F.struct("key", "hash")).alias("first")).collect()
    heads = sorted((r.place, r.first["key"], r.first["hash"]) for r in heads)
    follows = {(k, h): heads[i - 1][0] for i, (_, k, h) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def dealt_to(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        out = places(keys, hashes)
        heads = np.isin(keys.to_numpy(np.int64), np.array([k for k, _ in follows], np.int64))
        also = {i: follows.get((int(keys.iloc[i]), int(hashes.iloc[i]))) for i in np.flatnonzero(heads).tolist()}
        return pd.Series([[p] if also.get(i) is None else [p, -1 - also[i]] for i, p in enumerate(out.tolist())])

    dealt = (
        rows.withColumn("place", F.explode(dealt_to("key", "hash")))
        .withColumn("tail", F.col("place") < 0)
        .withColumn("place", F.when(F.col("tail"), -F.col("place") - 1).otherwise(F.col("place")))
        .repartition(width(spark), "place")
        .sortWithinPartitions("place", "tail", "key", "hash", "text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (place, doc_id, text) that waits for the next
        for batch in pieces(batches):
            ids, texts, following = [], [], []
            for place, tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("place", "tail", "doc_id", "text"))):
                if held and held[0] == place:
                    ids.append(held[1])
                    texts.append(held[2])
                    following.append(text)
                    held = None
                if not tail:
                    held = (place, doc, text)
            if not ids:
                continue
            changed = [edited(t, f) for t, f in zip(texts, following)]
            own, other, after = (sketches(pa.array(x, pa.string()), shingle, scale) for x in (texts, changed, following))
            yield pa.record_batch(
                [
                    pa.array(ids, batch.schema.field("doc_id").type),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array([spelt(x) for x in own]),
                    pa.array([spelt(x) for x in other]),
                    pa.array([containment(a, b) for a, b in zip(own, other)]),
                    pa.array([containment(a, b) for a, b in zip(own, after)]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.select("place", "tail", "doc_id", "text").mapInArrow(
        lean(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
