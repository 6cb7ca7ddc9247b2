"""Word hashes of batches of whole texts, and hashes of word sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed at once; a longer text is hashed alone.
STRETCH = 1 << 18
#: Odd multipliers (fixed values: the golden ratio and the finaliser constants of a public 64-bit mixer).
STEP = U64(0x9E3779B97F4A7C15)
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * STEP)


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2**64, at least n of each; those of a stretch are kept by a worker."""
    if not _powers or len(_powers["up"]) < n:
        made = {}
        for name, factor in (("up", int(STEP)), ("down", pow(int(STEP), -1, 1 << 64))):
            own = np.full(max(n, STRETCH), factor, U64)
            own[0] = 1
            made[name] = np.multiply.accumulate(own)
        if n > 2 * STRETCH:  # one very long text
            return made["up"], made["down"]
        _powers.update(made)
    return _powers["up"], _powers["down"]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, start of each text's words and the end), as below, for stretches of about STRETCH bytes."""
    raw = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"").cast(pa.binary())
    ends = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // STRETCH)) + 1).tolist(), len(raw)]
    hashes, starts, before = [], [], 0
    for s, e in zip(cuts[:-1], cuts[1:]):
        own, at = _word_hashes(raw.slice(s, e - s), lower)
        hashes.append(own)
        starts.append(at[:-1] + before)
        before += len(own)
    return np.concatenate([np.zeros(0, U64), *hashes]), np.concatenate([np.zeros(0, np.int64), *starts, [before]]).astype(np.int64)


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is each byte part of a word, first byte of each word, byte after it) of texts that ``offsets`` cut ``data`` into."""
    n = len(data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    # A word begins after white space or at its text's beginning.
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return inside, np.flatnonzero(first), np.flatnonzero(last) + 1


def _word_hashes(raw: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, start of each text's words and the end): words lie between ASCII white space; null: none.

    A word's hash is a polynomial of its bytes' values modulo 2**64, from running sums over the whole batch, mixed with
    its length.
    """
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    if not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, U64), np.zeros(len(raw) + 1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    _, begin, end = _bounds(data, offsets)
    values = _byte_values()
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64)), np.searchsorted(begin, offsets)


@dataclass
class Split:
    """Words of a batch of texts: ``ids`` are equal for equal words (and for no others), ``hashes`` are the words' names
    anywhere. Text i has the words ``starts[i]`` to ``starts[i + 1]``; word k is ``joined[begin[k]:end[k]]``, and one
    space parts it from the next of its text."""

    ids: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    joined: bytes
    begin: np.ndarray
    end: np.ndarray

    def texts(self, first: np.ndarray, after: np.ndarray) -> list[bytes]:
        """The words from ``first`` to before ``after``, joined by one space, for each pair."""
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.begin[first].tolist(), self.end[after - 1].tolist())]


def split_words(texts: pa.Array) -> Split:
    """The words between ASCII white space of every text; a null has none."""
    raw = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"").cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    if not len(offsets) or offsets[-1] == offsets[0]:
        none = np.zeros(0, np.int64)
        return Split(none, np.zeros(0, U64), np.zeros(len(raw) + 1, np.int64), b"", none, none)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    inside, begin, end = _bounds(data, offsets - offsets[0])
    starts = np.searchsorted(begin, offsets - offsets[0])
    ends = np.cumsum(end - begin)
    edges = np.concatenate([[0], ends]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data[inside])]).dictionary_encode()
    ids = found.indices.to_numpy().astype(np.int64)
    hashes, _ = word_hashes(found.dictionary)
    # A word and its length of letters say where it stands once every word is followed by one space.
    at = np.arange(len(begin), dtype=np.int64)
    spaced = np.full(int(ends[-1]) + len(begin), 32, np.uint8)
    spaced[np.arange(int(ends[-1]), dtype=np.int32) + np.repeat(at.astype(np.int32), end - begin)] = data[inside]
    return Split(ids, hashes[ids], starts, spaced.tobytes(), edges[:-1] + at, ends + at)


def sequence_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on (``len(words) - length + 1`` values), by doubling."""
    if len(words) < length:
        return np.zeros(0, U64)
    b = U64(base | 1)
    out, done, power, span = None, 0, words, 1
    factor = b  # base ** span
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = power, span
                else:
                    n = len(words) - (done + span) + 1
                    out, done = out[:n] * factor + power[done : done + n], done + span
            rest >>= 1
            if rest:
                n = len(power) - span
                power = power[:n] * factor + power[span:]
                factor = factor * factor
                span *= 2
        return mix(out[: len(words) - length + 1] + STEP)
