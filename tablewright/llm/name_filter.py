"""A filter of 64-bit names of bounded size, for settling most rows without an exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.storage import lean, quoted, width
from tablewright.llm.words import U64

#: Bits for each name, and bits in all at most (64 MB): beyond that more rows pass, and no result changes.
FILTER_BITS_EACH, FILTER_BITS = 16, 1 << 29
#: Bits of a filter block; a name's block and its two bits come from the name.
BLOCK_BITS = 1 << 15


def _blocks(names: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block = (names >> U64(30)) % U64(n_blocks)
    return block.astype(np.int64), (names & U64(BLOCK_BITS - 1)).astype(np.int64), (names >> U64(15) & U64(BLOCK_BITS - 1)).astype(np.int64)


class NameFilter:
    """Which names may be held: a blocked Bloom filter of at most FILTER_BITS bits."""

    def __init__(self, n_blocks: int):
        self.n_blocks, self.bits = n_blocks, np.zeros(n_blocks * (BLOCK_BITS // 8), np.uint8)

    def may_hold(self, names: np.ndarray) -> np.ndarray:
        block, a, b = _blocks(names, self.n_blocks)
        hit = np.ones(len(names), bool)
        for bit in (a, b):
            hit &= (self.bits[block * (BLOCK_BITS // 8) + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
        return hit


def filter_of(names: DataFrame) -> NameFilter:
    """The filter of ``names(name)``, longs whose bits are well mixed. Tasks fill whole blocks; the driver gets those."""
    n = max(1, names.count())
    n_blocks = min(-(-n * FILTER_BITS_EACH // BLOCK_BITS), FILTER_BITS // BLOCK_BITS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, a, b = _blocks(batch.column(0).to_numpy().view(U64), n_blocks)
            yield pa.record_batch([pa.array(block.astype(np.int32)), pa.array((a << 16 | b).astype(np.int32))], names=["block", "bits"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(part):
                    own = held.setdefault(int(block[part[0]]), np.zeros(BLOCK_BITS, bool))
                    own[bits[part] >> 16] = True
                    own[bits[part] & 0xFFFF] = True
        yield pa.record_batch(
            [pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["block", "bytes"]
        )

    found = NameFilter(n_blocks)
    size = BLOCK_BITS // 8
    dealt = names.mapInArrow(lean(number), "block int, bits int").repartition(width(names.sparkSession), "block")
    for row in dealt.mapInArrow(lean(fill), "block int, bytes binary").collect():
        found.bits[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bytes, np.uint8)
    return found


def may_hold(df: DataFrame, names: NameFilter, name: Column) -> Column:
    """Whether the filter may hold the name, as a column of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(names)

    @F.arrow_udf("boolean")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(values.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)))

    return run(name)


def text_hash(text: Column) -> Column:
    """A hash of a text; null and blank texts are alike."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(whole.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(whole)).otherwise(F.lit(0).cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, same, row) of every row of ``docs(doc_id, text)``: rows are told apart by id and text, with or without an id."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("same"), F.struct(*map(quoted, docs.columns)).alias("row"))


def among(rows: DataFrame, keys: DataFrame) -> Column:
    """Whether a row of ``rows(id, same)`` may be among ``keys(id, same)``: true for all that are, and for few others."""
    return may_hold(rows, filter_of(keys.select(F.xxhash64("id", "same").alias("name"))), F.xxhash64("id", "same"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` whose id and text aren't among the distinct ``keys(id, same)``.

    Rows that the filter of keys can't hold stay where they are. Only the others meet the keys in a join.
    """
    rows = keyed(docs)
    may = among(rows, keys)
    maybe = rows.where(may)
    left = maybe.join(keys, maybe["id"].eqNullSafe(keys["id"]) & (maybe["same"] == keys["same"]), "left_anti")
    return rows.where(~may).unionByName(left).select("row.*")
