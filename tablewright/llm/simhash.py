"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks, one more than half the threshold: 22, 21 and 21 bits for a threshold of four.
Two fingerprints within the threshold differ in at most one bit of some block. Each block is padded to 23 bits, where the words of the binary Golay code are
anchors with covering radius 3: every value lies within 3 bits of exactly one anchor, its home, and a value that
differs from it in one bit lies within 3 + 1 bits of that same anchor. So a fingerprint is filed under its home anchor
and replicated to every anchor within 4 bits, in each block, and pairs are compared within an anchor only. No pair of
linked fingerprints is missed, whatever their number.

Equal fingerprints are one row before anything is compared, and an anchor emits a spanning forest of its links rather
than all pairs, so that a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.components import components
from tablewright.llm.name_filter import among, keyed, text_hash, without
from tablewright.llm.storage import bound_batches, drop, lean, pieces, width, written
from tablewright.llm.words import mix, sequence_hashes, word_hashes

SHINGLE = 4
THRESHOLD = 4
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_LENGTH, GOLAY_BITS, RADIUS = 23, 12, 3
#: Fingerprints of one anchor that are compared directly; more are first filed again by the bits that remain.
DIRECT = 2048
#: Fingerprints from which an anchor's are spread over tasks.
WIDE = 8_000_000


def fingerprint_bytes(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of each shingle."""
    words = text.lower().split()
    if not words:
        return 0
    return int(_majorities(np.array(_shingle_hashes(words, shingle), np.uint64), np.array([0]))[0])


def _shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())]


def _majorities(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each segment of hashes, the bits that over half of them have."""
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(hashes))
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        bits = np.unpackbits(hashes[s:e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        on = bits.sum(axis=0, dtype=np.int64) * 2 > e - s
        out[k] = np.packbits(on, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, distinct: bool = False, sketch: int | None = None) -> DataFrame:
    """(doc_id, fp, fp2, same) of every row; a null or blank text has fp 0. fp is the unsigned fingerprint's bits as a long.

    ``distinct`` takes each shingle once. fp2 is a second fingerprint by other hashes of the same shingles. same is a
    hash of the text, null and blank texts alike. ``sketch`` adds sketch, the :func:`minima` of the distinct shingles of
    so many words (null for a null or blank text), and nib1 and nib2, the lowest four bits of the first 32 of them.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps, others = (np.zeros(batch.num_rows, np.uint64) for _ in range(2))
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").lower().split()
                if words:
                    hashes = np.array(_shingle_hashes(words, shingle), np.uint64)
                    if distinct:
                        hashes = np.unique(hashes)
                        others[i] = _majorities(mix(hashes), np.array([0]))[0]
                    fps[i] = _majorities(hashes, np.array([0]))[0]
            columns, names = [batch.column(0), *(pa.array(x.view(np.int64)) for x in (fps, others)), batch.column(2)], ["doc_id", "fp", "fp2", "same"]
            if sketch:
                found = [minima(x) if len(x) else None for x in shingle_sets(batch.column(1), sketch)]
                nibbles = _nibbles(np.stack([x if x is not None else np.zeros(BANDS * ROWS, np.uint32) for x in found]))
                columns += [pa.array([x.tobytes() if x is not None else None for x in found], pa.binary()), *(pa.array(n.view(np.int64)) for n in nibbles)]
                names += ["sketch", "nib1", "nib2"]
            yield pa.record_batch(columns, names=names)

    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, text_hash(F.col("text")).alias("same")).mapInArrow(
        lean(run), "doc_id long, fp long, fp2 long, same long" + (", sketch binary, nib1 long, nib2 long" if sketch else "")
    )


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit single error, nearest-word error pattern by syndrome)."""
    units = np.zeros(GOLAY_LENGTH, np.int64)
    for bit in range(GOLAY_LENGTH):
        value = 1 << bit
        for shift in range(GOLAY_LENGTH - 1, GOLAY_LENGTH - GOLAY_BITS - 1, -1):
            if value >> shift & 1:
                value ^= GOLAY_POLYNOMIAL << (shift - (GOLAY_LENGTH - GOLAY_BITS))
        units[bit] = value
    error = np.zeros(1 << (GOLAY_LENGTH - GOLAY_BITS), np.int64)
    for i in range(GOLAY_LENGTH):
        error[units[i]] = 1 << i
        for j in range(i):
            error[units[i] ^ units[j]] = 1 << i | 1 << j
            for k in range(j):
                error[units[i] ^ units[j] ^ units[k]] = 1 << i | 1 << j | 1 << k
    return units, error


def _syndromes(values: np.ndarray) -> np.ndarray:
    units, _ = _golay()
    out = np.zeros(len(values), np.int64)
    for bit in range(GOLAY_LENGTH):
        out ^= np.where(values >> bit & 1, units[bit], 0)
    return out


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, is_home) rows: each value's home, then every other anchor within RADIUS + 1 bits of it."""
    units, error = _golay()
    syndromes = _syndromes(values)
    home = values ^ error[syndromes]
    found = np.stack([home] + [(values ^ 1 << bit) ^ error[syndromes ^ units[bit]] for bit in range(GOLAY_LENGTH)], axis=1)
    found.sort(axis=1)
    keep = np.ones(found.shape, bool)
    keep[:, 1:] = found[:, 1:] != found[:, :-1]
    index, place = np.nonzero(keep)
    anchor = found[index, place]
    return index, anchor, anchor == home[index]


def blocks(threshold: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the blocks of which one differs in at most one bit between fingerprints within the threshold."""
    if not 4 <= threshold <= 15:
        raise ValueError("the threshold is 4 to 15 bits")
    at = [64 * i // (threshold // 2 + 1) for i in range(threshold // 2 + 2)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:])]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest_links(home: np.ndarray, near: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join whatever a home fingerprint and another of this anchor, at most ``threshold`` bits apart, join."""
    every = np.concatenate([home, near])
    pairs = forest(every, np.arange(len(every)) < len(home), threshold)
    return [(int(every[i]), int(every[j])) for i, j in pairs]


def forest(every: np.ndarray, is_home: np.ndarray, threshold: int, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of places that join whatever a home fingerprint and another one, at most ``threshold`` bits apart, join.

    ``alike(i, members)`` says which of the members are also alike otherwise. A large anchor files its fingerprints again
    by ``threshold + 1`` blocks of all 64 bits, one of which a linked pair shares; a block value that many share is
    compared in strips. The result has fewer pairs than fingerprints.
    """
    found, links = _Forest(len(every)), []

    def compare(members: np.ndarray) -> None:
        values = every[members]
        for i in members[is_home[members]].tolist():
            close = members[_bits(values ^ every[i]) <= threshold]
            if alike is not None and len(close) > 1:
                close = close[alike(i, close)]
            root = found.find(i)
            for j in close.tolist():
                if found.up[j] != root and found.join(i, j):
                    links.append((i, j))
                    root = found.find(i)

    if len(every) <= DIRECT:
        compare(np.arange(len(every)))
    else:
        cuts = np.linspace(0, 64, threshold + 2).astype(int)
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = every >> np.uint64(low) & np.uint64((1 << int(high - low)) - 1)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            for members in np.split(order, edges):
                if len(members) > 1:
                    compare(members)
    return links


def links(fps: DataFrame, threshold: int = THRESHOLD, wide: bool | None = None) -> DataFrame:
    """(a, b) links whose components are those of all pairs of ``fps`` within ``threshold``.

    There are some thousands of anchors for each block. Of more than WIDE fingerprints (``wide`` sets it) an anchor's are
    dealt out again by ``threshold + 1`` parts of all 64 bits, one of which a linked pair shares, so that one task's
    share stays small; the links' components are the same.

    ``fps(fp)`` are distinct fingerprints and links are between them. ``fps(fp, id, nib1, nib2)`` are texts by a distinct
    id, links are between ids, and a pair within the threshold also needs NIBBLES equal nibbles of its minima.
    """
    cuts, texts = blocks(threshold), "id" in fps.columns
    more = ["id", "nib1", "nib2"] if texts else []
    wide = fps.count() > WIDE if wide is None else wide
    edges = np.linspace(0, 64, threshold + 2).astype(int).tolist()
    parts_of = list(zip(edges[:-1], edges[1:])) if wide else [(0, 0)]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, *others = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            for k, (low, size) in enumerate(cuts):
                index, anchor, at_home = anchors((fp.view(np.uint64) >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64))
                columns = [pa.array(at_home), *(pa.array(x[index]) for x in (fp, *others))]
                for j, (a, b) in enumerate(parts_of):
                    part = fp[index] >> a & (1 << b - a) - 1
                    yield pa.record_batch([pa.array((part << 5 | j) << 27 | anchor << 4 | k), *columns], names=["anchor", "home", "fp", *more])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if parts:
                at_home, fp, *others = (np.concatenate(x) for x in zip(*parts))
                if at_home.any() and len(fp) > 1:
                    alike = (lambda i, js: _equal_nibbles(others[1:], i, js) >= NIBBLES) if texts else None
                    found = np.array(forest(fp.view(np.uint64), at_home, threshold, alike), np.int64).reshape(-1, 2)
                    if len(found):
                        ids = others[0] if texts else fp
                        yield pa.record_batch([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            cuts = np.flatnonzero(np.diff(key)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if e > s:
                    if key[s] != anchor:
                        yield from close()
                        anchor, parts = key[s], []
                    parts.append([c[s:e].copy() for c in columns])
        yield from close()

    spark = fps.sparkSession
    kinds = ", ".join(f"{c} long" for c in ("fp", *more))
    spread = fps.select("fp", *more).mapInArrow(lean(replicate), f"anchor long, home boolean, {kinds}")
    dealt = spread.repartition(width(spark), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(lean(compare), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of at most ``threshold`` differing bits. Blank and null
    texts have fingerprint zero and link like any other. Repeated rows each give a row. A null doc_id keeps its row and
    counts as no id: its component is the smallest real one, or null. Other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(first.select("fp"), threshold))
    joined = first.join(roots, first.fp == roots.id, "left").select(
        first.fp, "first", F.coalesce("root", first.fp).alias("root")
    )
    best = written(joined.groupBy("root").agg(F.min("first").alias("component_id")), "best")
    labels = written(joined.join(best, "root").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For documents that must be alike, not only close in fingerprint: fingerprints of distinct word pairs, whose distance
#: stays small for texts that share four fifths of their longer shingles, and members that one task compares.
PAIR_SHINGLE, PAIR_THRESHOLD, MEMBERS = 2, 9, 512
TEXT_SHINGLE, SIMILARITY = 5, 0.8
SET_BASE = 0x3C79AC492BA7B653
#: Sketches of BANDS x ROWS minima find what both fingerprints miss: sets of Jaccard similarity J share all of a band with
#: probability J ** ROWS. Sketches that share a band are linked if AGREE minima or more are equal.
BANDS, ROWS, AGREE = 28, 4, 68
#: Of 32 nibbles of minima so many must be equal for a pair of near fingerprints to be linked: sets of similarity 0.8 have
#: 26 on average and fewer than this with a probability of about one in 100,000, unrelated ones have two.
NIBBLES = 16
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_FLIPS, _FACTORS = ((_SEEDS[k :: 2] >> np.uint64(32)).astype(np.uint32)[:, None] for k in (0, 1))
_FACTORS = _FACTORS | np.uint32(1)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles; a shorter text is one shingle, a blank one has none."""
    words, starts = word_hashes(texts, lower=True)
    hashes = sequence_hashes(words, shingle, SET_BASE)
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        n = e - s
        one = hashes[s : e - shingle + 1] if n >= shingle else sequence_hashes(words[s:e], n, SET_BASE) if n else hashes[:0]
        yield np.unique(one >> np.uint64(1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each of BANDS x ROWS other hashes."""
    own = (hashes >> np.uint64(20)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(own), 1024):
        np.minimum(out, ((own[low : low + 1024] ^ _FLIPS) * _FACTORS).min(axis=1), out=out)
    return out


def _nibbles(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest four bits of the first 32 minima of each row, 16 to a word."""
    low = (rows[:, :32] & np.uint32(15)).astype(np.uint64).reshape(len(rows), 2, 16)
    words = np.bitwise_or.reduce(low << np.arange(0, 64, 4, dtype=np.uint64), axis=2)
    return words[:, 0].copy(), words[:, 1].copy()


def _equal_nibbles(words: list[np.ndarray], i: int, js: np.ndarray) -> np.ndarray:
    """How many of the 32 nibbles of row ``i`` the rows ``js`` share."""
    unequal = 0
    for w in words:
        x = (w[js] ^ w[i]).view(np.uint64)
        x = x | x >> np.uint64(1)
        x = x | x >> np.uint64(2)
        unequal = unequal + np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int64)
    return 32 - unequal


def sketch_forest(fps: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever pairs of sketches with at least AGREE equal minima join."""
    left, links = np.arange(len(fps)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            close = (sketches[left] == sketches[i]).sum(axis=1) >= AGREE
            links += [(int(fps[i]), int(fps[j])) for j in left[close]]
            frontier += left[close].tolist()
            left = left[~close]
    return links


def sketch_links(texts: DataFrame) -> DataFrame:
    """(a, b) links of ``texts(id, sketch)`` whose sketches share a band and agree."""
    spark = texts.sparkSession
    own = texts.where("sketch is not null").select("id", "sketch")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
                for k in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
                ids = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], names=["band", "id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, ids, sketches = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and (found := sketch_forest(np.array(ids, np.int64), np.frombuffer(b"".join(sketches), np.uint32).reshape(len(ids), -1))):
                yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k, id_, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if k != band:
                    yield from close()
                    band, ids, sketches = k, [], []
                ids.append(id_)
                sketches.append(sketch)
        yield from close()

    filed = written(own.select("id", "sketch").mapInArrow(lean(bands), "band long, id long"), "bands")
    shared = written(filed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    met = filed.join(shared, "band").join(own, "id").select("band", "id", "sketch")
    return met.repartition(width(spark), "band").sortWithinPartitions("band").mapInArrow(lean(compare), "a long, b long")


def alike_links(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join whatever pairs of sets of at least that Jaccard similarity join."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column) > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common
    forest, links = _Forest(len(sets)), []
    for i, j in np.argwhere(np.triu((common >= similarity * both) & (both > 0), 1)).tolist():
        if forest.join(i, j):
            links.append((ids[i], ids[j]))
    return links


def alike_texts(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = TEXT_SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(id, same) of every row, and (same, kept_id, kept_same) of every text: its group's representative.

    Rows are told by doc_id and a hash of the text; equal texts, and null and blank ones, are one text. Texts are
    linked if two fingerprints of distinct word pairs lie within PAIR_THRESHOLD bits and their minima agree, or by
    sketches of the shingles themselves (:func:`sketch_links`): where a block of text was added, cut off or replaced,
    the fingerprints lie further apart. Within the components of these links all pairs are compared by the Jaccard
    similarity of their distinct shingles, in blocks of about MEMBERS texts, each of which emits a spanning forest of
    its links; the groups are those links' components. Words are lower-cased (A-Z). A representative is the text with the
    smallest doc_id, a text without any id only if its whole group has none.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs, PAIR_SHINGLE, distinct=True, sketch=shingle), "fingerprints")
    once = [F.first(c).alias(c) for c in ("fp", "fp2", "nib1", "nib2", "sketch")]
    texts = written(prints.groupBy(F.col("same").alias("id")).agg(F.min("doc_id").alias("rep"), *once), "texts")
    rows = written(prints.select(F.col("doc_id").alias("id"), "same"), "rows")
    drop(prints)
    near = [links(texts.select(F.col(c).alias("fp"), "id", "nib1", "nib2"), PAIR_THRESHOLD) for c in ("fp", "fp2")]
    roots = components(near[0].unionByName(near[1]).unionByName(sketch_links(texts)))
    classed = written(texts.select("id", "rep").join(roots.withColumnRenamed("id", "same"), F.col("id") == F.col("same"), "left").select("id", "rep", F.coalesce("root", "id").alias("class")), "classes")
    sizes = written(classed.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    members = classed.join(sizes, "class").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = written(members.select("class", F.col("id").alias("same"), F.col("rep").alias("id"), "block", "blocks"), "members")
    drop(sizes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [x.astype(np.int64).tobytes() for x in shingle_sets(batch.column("text"), shingle)]
            yield pa.record_batch([*(batch.column(c) for c in ("class", "same", "block", "blocks")), pa.array(own, pa.binary())], names=["class", "same", "block", "blocks", "set"])

    # Only a text's row with its smallest id is dealt out, and of several such rows one goes on.
    every = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash(F.col("text")).alias("same"), F.col("text").cast("string").alias("text"))
    bodies = every.where(among(every, members.select("id", "same"))).select(F.col("id").alias("own"), "same", "text")
    met = members.join(bodies, "same").where(F.col("id").eqNullSafe(F.col("own"))).dropDuplicates(["same"])
    found = met.select("class", "same", "block", "blocks", "text").mapInArrow(lean(sets), "class long, same long, block int, blocks int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        found.withColumn("other", other)
        .select("class", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "same", "set")
        .repartition(width(spark), "class", "a", "b")
        .sortWithinPartitions("class", "a", "b", "same")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own = None, [], []

        def told(out: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, same, one in zip(zip(*(batch.column(c).to_pylist() for c in ("class", "a", "b"))), batch.column("same").to_pylist(), batch.column("set").to_pylist()):
                if k != key:
                    if len(ids) > 1:
                        out += alike_links(ids, own, similarity)
                    key, ids, own = k, [], []
                ids.append(same)
                own.append(np.frombuffer(one, np.int64))
            yield from told(out)
        if len(ids) > 1:
            yield from told(alike_links(ids, own, similarity))

    joined = components(dealt.mapInArrow(lean(compare), "a long, b long")).select(F.col("id").alias("same"), "root")
    labels = written(texts.select(F.col("id").alias("same"), "rep").join(joined, "same", "left").select("same", "rep", F.coalesce("root", "same").alias("root")), "labels")
    drop(texts, classed, members)
    best = labels.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "same")).alias("best"))
    kept = written(labels.join(best, "root").select("same", F.col("best.rep").alias("kept_id"), F.col("best.same").alias("kept_same")), "kept")
    drop(labels)
    return rows, kept


def alike_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = TEXT_SHINGLE) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its group (:func:`alike_texts`), null if none has one."""
    rows, kept = alike_texts(docs, similarity, shingle)
    return rows.join(kept, "same").select(F.col("id").alias("doc_id"), F.col("kept_id").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = TEXT_SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of :func:`alike_texts`: one with its representative's id and text.

    Rows without an id are judged like any other. Of rows that repeat id and text any one stays. Other columns are kept,
    whatever their names; a text of any length is one row's work, and an empty table gives an empty result.
    """
    rows, kept = alike_texts(docs, similarity, shingle)
    counted = rows.groupBy("id", "same").agg(F.count("*").alias("n")).join(kept, "same")
    stays = (F.col("same") == F.col("kept_same")) & F.col("id").eqNullSafe(F.col("kept_id"))
    judged = written(counted.select("id", "same", stays.alias("stays"), (F.col("n") > 1).alias("again")).where("not stays or again"), "judged")
    left = without(docs, judged.select("id", "same"))
    again = judged.where("stays").select("id", "same")
    if not again.limit(1).count():
        return left
    maybe = keyed(docs)
    maybe = maybe.where(among(maybe, again))
    met = maybe.join(again, maybe["id"].eqNullSafe(again["id"]) & (maybe["same"] == again["same"]), "left_semi")
    return left.unionByName(met.groupBy("id", "same").agg(F.first("row").alias("row")).select("row.*"))
