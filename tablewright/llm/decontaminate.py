"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet at shared seeds, sequences of as many words as the least tile. For a pair with a
seed, rounds of running Karp-Rabin matching find common word sequences of a search length and more, mark the longest
that don't overlap what is marked, and shorten the search length down to the least tile, so that passages are found
in any order. A document is contaminated by an item if its tiles cover a set share of the item's words.

The benchmark is the query set: it is taken in blocks of a bounded size. The documents are read once.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tablewright.llm.name_filter import NameFilter, filter_of
from tablewright.llm.storage import bound_batches, drop, lean, pieces, written
from tablewright.llm.words import U64, sequence_hashes

#: Least tile in words, share of an item's words that tiles must cover, characters of benchmark text in a block.
TILE, COVERAGE, BLOCK_CHARS = 5, 0.5, 4_000_000
WORD = re.compile(r"\w+")
SEED_BASE = 0x369DEA0F31A53F85


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def tiles(item: np.ndarray, text: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of greedy tiles of at least ``least`` words; -1 never matches."""
    n, m = len(item), len(text)
    marked_item, marked_text = np.zeros(n, bool), text < 0
    found: list[tuple[int, int, int]] = []
    search = max(least, min(n, m))
    while search >= least and n >= least and m >= least:
        longest, matches = _scan(item, text, marked_item, marked_text, search)
        if longest > 2 * search:
            search = longest
            continue
        heapq.heapify(matches)
        while matches:
            size, i, j = heapq.heappop(matches)
            free = ~(marked_item[i : i - size] | marked_text[j : j - size])
            if free.all():
                marked_item[i : i - size] = marked_text[j : j - size] = True
                found.append((i, j, -size))
            else:  # what a longer tile leaves of this match
                edges = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]]))).reshape(-1, 2).tolist()
                for s, e in edges:
                    if e - s >= search:
                        heapq.heappush(matches, (s - e, i + s, j + s))
        if search == least:
            break
        search = max(least, search // 2)
    return found


def _scan(item: np.ndarray, text: np.ndarray, marked_item: np.ndarray, marked_text: np.ndarray, search: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(longest, matches): maximal unmarked common sequences of ``search`` words or more as (-length, i, j), by rolling hashes."""
    matches: list[tuple[int, int, int]] = []
    n, m = len(item), len(text)
    if n < search or m < search:
        return 0, matches
    free = lambda marked: np.convolve(marked, np.ones(search, np.int64), "valid") == 0
    own, other = (sequence_hashes(x.astype(np.int64).view(U64), search, SEED_BASE) for x in (item, text))
    table = defaultdict(list)
    for i in np.flatnonzero(free(marked_item)).tolist():
        table[int(own[i])].append(i)
    starts = np.flatnonzero(free(marked_text) & np.isin(other, np.array(list(table), U64)))
    longest = 0
    for j in starts.tolist():
        for i in table[int(other[j])]:
            if i and j and item[i - 1] == text[j - 1] and not marked_item[i - 1] and not marked_text[j - 1]:
                continue  # part of the match that begins one word before
            k = 0
            while i + k < n and j + k < m and item[i + k] == text[j + k] and not marked_item[i + k] and not marked_text[j + k]:
                k += 1
            if k >= search:
                matches.append((-k, i, j))
                longest = max(longest, k)
                if longest > 2 * search:
                    return longest, matches
    return longest, matches


class Benchmark:
    """Word numbers, items and seeds of one block of the benchmark: sorted seeds, and for each the items that have it."""

    def __init__(self, items: list[tuple[object, str]], least: int = TILE):
        self.least = least
        self.number: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if words:
                own = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32)
                size = min(least, len(own))
                found[size].append((np.unique(sequence_hashes(own.astype(U64), size, SEED_BASE)), len(self.items)))
                self.items.append((item_id, own))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            hashes = np.concatenate([h for h, _ in parts])
            of = np.repeat(np.array([k for _, k in parts], np.int32), [len(h) for h, _ in parts])
            by = np.argsort(hashes, kind="stable")
            seeds, first = np.unique(hashes[by], return_index=True)
            self.seeds[size] = seeds, np.append(first, len(by)), of[by]

    def find(self, fragments: list[list[str]], coverage: float) -> list[tuple[object, int, int, int]]:
        """(item_id, its words, words tiled, tiles) of each item whose coverage by the text's fragments reaches ``coverage``."""
        get = self.number.get
        own = np.array([x for words in fragments for x in (*[get(w, -1) for w in words], -1)], np.int64)
        known = own >= 0
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, (seeds, first, items) in self.seeds.items():
            if len(own) < size:
                continue
            whole = np.flatnonzero(np.convolve(known, np.ones(size, np.int64), "valid") == size)
            if not len(whole):
                continue
            got = sequence_hashes(own.view(U64), size, SEED_BASE)[whole]
            at = np.minimum(np.searchsorted(seeds, got), len(seeds) - 1)
            hit = seeds[at] == got
            for j, k in zip(whole[hit].tolist(), at[hit].tolist()):
                for item in items[first[k] : first[k + 1]].tolist():
                    places[item].append((j, size))
        out = []
        for k, found in places.items():
            item_id, item = self.items[k]
            size = found[0][1]
            # Every tile lies within a stretch of seeds: the rest of the text can't match and is left out.
            keep = np.zeros(len(own) + 1, np.int64)
            for j, _ in found:
                keep[j] += 1
                keep[j + size] -= 1
            inside = np.cumsum(keep[:-1]) > 0
            if inside.sum() < coverage * len(item) and np.unique(own[inside]).size < coverage * np.unique(item).size:
                continue
            cut = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]))).reshape(-1, 2)
            text_words = np.concatenate([np.append(own[a:b], -1) for a, b in cut.tolist()])
            laid = tiles(item.astype(np.int64), text_words, size)
            covered = sum(t[2] for t in laid)
            if covered >= coverage * len(item):
                out.append((item_id, len(item), covered, len(laid)))
        return out


def _names(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U64, len(words))


def seed_filter(rows: DataFrame, least: int = TILE) -> tuple[NameFilter, list[int]]:
    """The filter of the seeds of all items of ``rows(text)``, named by their words, and the seeds' sizes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if words:
                    size = min(least, len(words))
                    found = np.unique(sequence_hashes(_names(words), size, SEED_BASE))
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.full(len(found), size, np.int32))], names=["name", "size"])

    seeds = written(rows.select("text").mapInArrow(lean(emit), "name long, size int").distinct(), "seeds")
    found = filter_of(seeds.select("name").distinct()), sorted(r.size for r in seeds.select(F.col("size").alias("size")).distinct().collect())
    drop(seeds)
    return found


def fragments(docs: DataFrame, names: NameFilter, sizes: list[int]) -> DataFrame:
    """(doc_id, fragments) of every row that may hold a seed: the stretches of words that its possible seeds cover."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, kept = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                hashes, covered = _names(words), np.zeros(len(words) + 1, np.int64)
                for size in sizes:
                    if len(words) >= size:
                        hit = np.flatnonzero(shared.value.may_hold(sequence_hashes(hashes, size, SEED_BASE)))
                        np.add.at(covered, hit, 1)
                        np.add.at(covered, hit + size, -1)
                inside = np.cumsum(covered[:-1]) > 0
                if inside.any():
                    at.append(i)
                    cut = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]]))).reshape(-1, 2)
                    kept.append([" ".join(words[a:b]) for a, b in cut.tolist()])
            if at:
                yield pa.record_batch([batch.column("doc_id").take(pa.array(at)), pa.array(kept, pa.list_(pa.string()))], names=["doc_id", "fragments"])

    return docs.mapInArrow(lean(run), StructType([docs.schema["doc_id"], StructField("fragments", ArrayType(StringType()))]))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, tiled_words, n_tiles, coverage) of every document and item whose tiles reach ``coverage``.

    Words are sequences of letters, digits and underscores, lower-cased. Items of fewer words than the least tile must
    stand whole; items and documents without words (null texts too) match nothing. Rows of ``docs`` and ``benchmark``
    that repeat each give rows of their own, ids may be of any type and null, and a text of any length is one row's work.
    Other columns are ignored. A clean document gives no row, an empty table no rows.

    A benchmark of one block meets the documents in one pass. A larger one first leaves of the documents only what its
    seeds may cover, by a filter of bounded size; block after block then meets those fragments, each broadcast alone.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["doc_id"], items.schema["item_id"], *(StructField(c, LongType()) for c in ("item_words", "tiled_words", "n_tiles"))])
    kind = to_arrow_type(items.schema["item_id"].dataType)

    def against(table: DataFrame, block: DataFrame) -> tuple[DataFrame, Broadcast]:
        held = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
        shared, cut = spark.sparkContext.broadcast(Benchmark(held, least)), "fragments" in table.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if cut else pieces(batches):
                at, found = [], []
                for i, body in enumerate(batch.column(1).to_pylist()):
                    own = [f.split(" ") for f in body] if isinstance(body, list) else [words_of(body)]
                    for x in shared.value.find(own, coverage):
                        at.append(i)
                        found.append(x)
                if found:
                    item, *numbers = zip(*found)
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(item, kind), *(pa.array(x, pa.int64()) for x in numbers)], names=schema.names)

        return table.mapInArrow(lean(run), schema), shared

    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = int(-(-size // block_chars)) or 1
    if n == 1:
        result = against(rows, items)[0]
    else:
        dealt = written(items.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(n))), "benchmark")
        left = written(fragments(rows, *seed_filter(dealt, least)), "fragments")
        found = []
        for k in range(n):
            part, shared = against(left, dealt.where(F.col("block") == k))
            found.append(written(part, "tiled"))
            shared.destroy()
        drop(dealt, left)
        result = reduce(DataFrame.unionByName, found)
    return result.withColumn("coverage", F.col("tiled_words") / F.col("item_words"))
