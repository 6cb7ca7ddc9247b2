"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A piece's adjacent pairs are the leaves of a segment tree of minima over ``rank << 32 | position``. The root is the
leftmost pair of the lowest rank; merging it changes two leaves and clears one, each in logarithmically many steps,
until no pair at the root can merge.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tablewright.llm.bpe_tables import SIMPLE, SPACE_CLASS, Merges, Remembered, library
from tablewright.llm.storage import as_rows, bound_batches, fields, lean, pieces

NEVER = 1 << 62
#: The vocabulary's own pattern, for lower-cased text of ASCII and western letters.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+", re.ASCII)
#: The normalizer and pre-tokenizer of the vocabulary file that this module stands for.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPACES = re.compile(f"[{SPACE_CLASS}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def merge_all(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """The symbols after every merge, lowest rank first and leftmost first among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = pairs.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        found = get(symbols[i] << 20 | symbols[i + 1])
        if found is not None:
            tree[size + i] = found >> 20 << 32 | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    if tree[1] == NEVER:
        return symbols
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != NEVER:
        i = top & 0xFFFFFFFF
        j = after[i]
        symbols[i] = merged = get(symbols[i] << 20 | symbols[j]) & 0xFFFFF
        symbols[j] = -1
        after[i] = k = after[j]
        # Three leaves change: the merged pair's, that of the symbol taken in, and the pair that ends in the merged one.
        low, high = size + i, size + j
        if j < n - 1:
            tree[high] = NEVER
        else:
            high = low
        if k < n:
            before[k] = i
            found = get(merged << 20 | symbols[k])
            tree[low] = NEVER if found is None else found >> 20 << 32 | i
        else:
            tree[low] = NEVER
        middle = low
        if (h := before[i]) >= 0:
            found = get(symbols[h] << 20 | merged)
            low = size + h
            tree[low] = NEVER if found is None else found >> 20 << 32 | h
        while low > 1:
            low >>= 1
            middle >>= 1
            high >>= 1
            a, b = tree[2 * low], tree[2 * low + 1]
            tree[low] = a if a < b else b
            if middle != low:
                a, b = tree[2 * middle], tree[2 * middle + 1]
                tree[middle] = a if a < b else b
            if high != middle:
                a, b = tree[2 * high], tree[2 * high + 1]
                tree[high] = a if a < b else b
    return [s for s in symbols if s >= 0]


class Codec:
    """Encoding and decoding of whole texts under one vocabulary.

    One memory holds the ids of words and of the pieces that words are cut into: a word that is its own only piece is
    merged, any other is looked up piece by piece. A piece spelt in byte symbols by the library is a key of bytes.
    """

    def __init__(self, path: str):
        self.merges, self.path = Merges(path, NORMALIZER, PRE_TOKENIZER), path
        self.known = Remembered(self.of)
        self.names = pa.array([self.merges.names.get(i, "") for i in range(max(self.merges.names, default=-1) + 1)])
        self.digits = pa.array([str(i) for i in range(len(self.names))])
        #: Ids are remembered as the bytes of such numbers.
        self.code = "H" if len(self.names) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.special = {s: array(self.code, [i]).tobytes() for s, i in self.merges.specials.items()}

    def of_piece(self, piece: str) -> bytes:
        """Ids of a piece of ASCII or in byte symbols."""
        return array(self.code, merge_all(self.merges.symbols(piece), self.merges.pairs)).tobytes()

    def of(self, word: str | bytes) -> bytes:
        """Ids of a word, or of a piece in byte symbols."""
        if isinstance(word, bytes):
            return self.of_piece(word.decode())
        if word.isascii() or SIMPLE.fullmatch(word):
            pieces = PRETOKEN.findall(word.lower())
            if len(pieces) == 1 and pieces[0] == word:
                return self.of_piece(word if word.isascii() else word.translate(self.merges.spelling))
        else:
            tokenizer = library(self.path)
            pieces = [x.encode() for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(word))]
        return b"".join(map(self.known.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        """The whole text's ids as bytes."""
        out: list[bytes] = []
        for segment, special in self.merges.segments(text):
            if special:
                out.append(self.special[segment])
            else:
                words = [w for w in SPACES.split(segment) if w] if SEPARATORS.search(segment) else segment.split()
                out += map(self.known.__getitem__, words)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.ids(text), self.kind).tolist()

    def joined(self, ids: pa.ListArray, of: pa.Array) -> list[bytes]:
        """What ``of`` has for each list of ids, joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, of.take(ids.values)), " ").cast(pa.binary()).to_pylist()

    def decode(self, ids: list[int]) -> str:
        """Token names joined by a space: the vocabulary has no decoder of its own. Special tokens stay."""
        return self.joined(pa.array([ids], pa.list_(pa.int32())), self.names)[0].decode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, texts: bool = True) -> DataFrame:
    """Ids and the text decoded from them for every row of ``docs``.

    Adds n_tokens, ids_sha256, decoded_sha256 (lower-case hex of the ids in decimal joined by one space, and of the
    decoded text) and, with ``texts``, ids (array) and decoded (string). A null text is empty: no ids, decoded text "".
    Every row gives a row, whatever the length of its text. The column names of the result replace equal names of
    ``docs``; others are left, whatever their names. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * texts]
    kept = [c for c in docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        try:
            for batch in pieces(fields(batches)):
                found = [bpe.ids(text) if text else b"" for text in batch.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int64) // bpe.kind.itemsize
                values = np.frombuffer(b"".join(found), bpe.kind).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                decoded = bpe.joined(ids, bpe.names)
                digests = [[hashlib.sha256(x).hexdigest() for x in joined] for joined in (bpe.joined(ids, bpe.digits), decoded)]
                out = [pa.array(np.diff(offsets)), *map(pa.array, digests)]
                if texts:
                    out += [ids, pa.array([x.decode() for x in decoded], pa.string())]
                yield pa.record_batch([*(batch.column(c) for c in kept), *out], names=[*kept, *made])
        finally:
            # Workers are kept for later tasks: what they remember is not.
            bpe.known.forget()
            library.cache_clear()

    rows = docs.select(as_rows(docs, kept))
    types = {"n_tokens": LongType(), "ids": ArrayType(IntegerType())}
    return rows.mapInArrow(lean(run), StructType([*rows.schema["row"].dataType, *(StructField(c, types.get(c, StringType())) for c in made)]))
