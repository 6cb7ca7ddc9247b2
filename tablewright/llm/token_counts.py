"""Token counts by byte-pair merging with a heap and a linked list.

The adjacent pairs of a piece's symbols lie in a heap by (rank, position) and the symbols in a doubly linked list. The
lowest is popped and merged until none is left; the count is the number of initial symbols minus the merges. No token
identifier is emitted. Pieces are the pre-tokens, which merges never cross, so a text's count is the sum of its
pieces' counts, and a worker remembers the counts of short pieces up to a bound.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.bpe_tables import CACHE_BYTES, SIMPLE, SPACE_CLASS, Merges, Remembered, library
from tablewright.llm.storage import bound_batches, lean, pieces

LIMIT = 1024
#: The vocabulary's own pattern, for text of ASCII and western letters.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+", re.ASCII)
#: Fixed value: the pre-tokenizer of the vocabulary file that this module stands for; it has no normalizer.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: A space that may belong to a longer run of white space.
RUN = re.compile(f" (?:[{SPACE_CLASS}]|\\Z)")


def merged_length(symbols: list[int], pairs: dict[int, int]) -> int:
    """Number of tokens that the symbols merge to."""
    n = len(symbols)
    if n < 2:
        return n
    get = pairs.get
    heap = []
    for i in range(n - 1):
        found = get(symbols[i] << 20 | symbols[i + 1])
        if found is not None:
            heap.append(found >> 20 << 32 | i)
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        left = symbols[i]
        if left < 0 or (j := after[i]) >= n:
            continue
        found = get(left << 20 | symbols[j])
        if found is None or found >> 20 != top >> 32:
            continue
        merges += 1
        symbols[i] = merged = found & 0xFFFFF
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = get(merged << 20 | symbols[k])
            if found is not None:
                heapq.heappush(heap, found >> 20 << 32 | i)
        if (h := before[i]) >= 0:
            found = get(symbols[h] << 20 | merged)
            if found is not None:
                heapq.heappush(heap, found >> 20 << 32 | h)
    return n - merges


class Counter:
    """Counts of whole texts under one vocabulary, kept by a Python worker."""

    def __init__(self, path: str):
        self.merges, self.path = Merges(path, None, PRE_TOKENIZER), path
        self.piece = Remembered(lambda piece: merged_length(self.merges.symbols(piece), self.merges.pairs))
        self.chunk = Remembered(self.of_chunk, CACHE_BYTES // 4)
        self.after_space = Remembered(lambda rest: self.of_chunk(" " + rest))

    def forget(self) -> None:
        for memory in (self.piece, self.chunk, self.after_space):
            memory.forget()

    def of_chunk(self, chunk: str) -> int:
        if chunk.isascii():
            return sum([self.piece[x] for x in PRETOKEN.findall(chunk)])
        if SIMPLE.fullmatch(chunk):
            return sum([self.piece[x.translate(self.merges.spelling)] for x in PRETOKEN.findall(chunk)])
        return sum(self.piece[x] for x, _ in library(self.path).pre_tokenizer.pre_tokenize_str(chunk))

    def count(self, text: str) -> int:
        total = 0
        for segment, special in self.merges.segments(text):
            if special:
                total += 1
            elif RUN.search(segment):
                total += self.of_chunk(segment)
            else:
                head, *rest = segment.split(" ")
                total += (self.chunk[head] if head else 0) + sum(map(self.after_space.__getitem__, rest))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text)``.

    Counts are those of the library for the vocabulary at ``path`` (a local file that every worker has) without added
    tokens, truncation or padding; special strings in a text count one token each. A null text is empty: 0 bytes,
    0 tokens. Every row gives a row, repeated or not, whatever its doc_id; other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        try:
            for batch in pieces(batches):
                texts = batch.column(1).to_pylist()
                yield pa.record_batch(
                    [batch.column(0), batch.column(2), pa.array([counts.count(t) if t else 0 for t in texts], pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )
        finally:
            counts.forget()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
