"""Removal of repeated passages by recompression.

Rounds rename a text's word sequence. The first names runs of one word; each of the following names adjacent pairs
whose left symbol is in the round's left half of the alphabet and right symbol in the right half (a bit of the symbol's
own name). A name is made from what it names, so it is the same everywhere in the corpus without an exchange, and
equal substrings get equal symbols everywhere but at their ends. For each window of words the rounds keep the range of
symbols that its own words determine, whatever stands beside it: a round takes away at most one symbol at either end.
The window's *anchor* is the longest symbol of its range (the greatest name among equals) after the last round whose
range isn't empty. Equal windows have equal anchors in equal places, and consecutive windows share theirs: a *stretch* is
consecutive windows of one text with one anchor in one place.

Shared symbols reveal repeats: anchors are counted over the corpus, and only stretches whose anchor repeats go on (a
filter of bounded size tells them; a false hit costs a row, never a result). They meet by anchor with the words of
their windows, and what is equal is settled there by comparing the words themselves: the first window of each word
sequence by document and place stays, the others are repeats. Places of repeats meet their texts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tablewright.llm.name_filter import NameFilter, filter_of, may_hold
from tablewright.llm.storage import as_rows, bound_batches, drop, lean, pieces, width, written
from tablewright.llm.words import U64, Split, mix, sequence_hashes, split_words

WINDOW = 20
#: Rounds of pairs. After three, a symbol has 2.4 words on average and a window still has a few of its own.
ROUNDS = 3
HASH_BASE = 0x5851F42D4C957F2D
#: Stretches of one anchor that meet in one task; a more frequent anchor is joined by the words of each window.
MOST = 10_000
LENGTH_BITS = 6


def name_runs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each run of one word, name of the run): a single word keeps its own name."""
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(words))).astype(U64)
    return begin, np.where(length > 1, mix(words[begin] ^ mix(length)), words[begin])


def name_pairs(names: np.ndarray, doc: np.ndarray, round_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first symbol of each new one, its name, which old symbols are in the right half) of a round of pairs."""
    salt = U64(0x632BE59BD9B4E019 * (round_no + 1) & (1 << 64) - 1)
    right = (mix(names + salt) >> U64(63)).astype(bool)
    joins = np.zeros(len(names), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])
    head = np.ones(len(names), bool)
    head[1:] = ~joins[:-1]
    heads = np.flatnonzero(head)
    follow = np.minimum(heads + 1, len(names) - 1)
    both = mix(names[heads] * U64(0x9FB21C651E98DF25) + (names[follow] ^ salt))
    return heads, np.where(joins[heads], both, names[heads]), right


def _greatest_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the first of the greatest values[low:high] for each pair, by maxima over power-of-two stretches."""
    out = np.empty(len(low), np.int64)
    size = high - low
    span, table = 1, np.arange(len(values))
    while len(size):
        own = np.flatnonzero((size >= span) & (size < 2 * span))
        if len(own):
            a, b = table[low[own]], table[high[own] - span]
            out[own] = np.where(values[a] >= values[b], a, b)
        if span * 2 > size.max():
            break
        if len(table) > span:
            a, b = table[:-span], table[span:]
            table = np.where(values[a] >= values[b], a, b)
        span *= 2
    return out


def anchors(words: np.ndarray, starts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, word where the anchor stands) of every window of the texts that ``starts`` cuts ``words`` into."""
    n = len(words)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    if not len(place):
        return place, np.zeros(0, U64), place
    # A window inside one long run has no symbol of its own after any round: its anchor is the word that it begins with.
    anchor, stands = mix(words[place] + U64(1)), place.copy()
    begin, names = name_runs(words, doc)
    run = np.searchsorted(begin, np.arange(n), side="right") - 1
    # A window knows all its runs but the outer two.
    low, high = run[place] + 1, run[place + window - 1]
    live = np.arange(len(place))
    for level in range(rounds + 1):
        ok = low < high
        live, low, high = live[ok], low[ok], high[ok]
        if not len(live):
            break
        if level < rounds:
            heads, merged, right = name_pairs(names, doc[begin], level)
            # The outer symbols may join what stands outside, unless their half of the alphabet forbids it.
            inner_low, inner_high = low + right[low], high - ~right[high - 1]
            stay = inner_low < inner_high
        else:
            stay = np.zeros(len(live), bool)
        ended = ~stay
        if ended.any():
            size = np.minimum(np.diff(np.append(begin, n)), (1 << LENGTH_BITS) - 1).astype(U64)
            rank = size << U64(64 - LENGTH_BITS) | names >> U64(LENGTH_BITS)
            chosen = _greatest_in(rank, low[ended], high[ended])
            anchor[live[ended]], stands[live[ended]] = mix(rank[chosen] + U64(level + 2)), begin[chosen]
        if level < rounds:
            symbol = np.searchsorted(heads, np.arange(len(names)), side="right") - 1
            live, low, high = live[stay], symbol[inner_low[stay]], symbol[inner_high[stay] - 1] + 1
            begin, names = begin[heads], merged
    return place, anchor, stands


@dataclass
class Stretches:
    """Consecutive windows of one text with one anchor in one place: word where the first begins, number, anchor, text."""

    place: np.ndarray
    n: np.ndarray
    name: np.ndarray
    row: np.ndarray


def stretches(split: Split, window: int, rounds: int) -> Stretches:
    place, anchor, stands = anchors(split.hashes, split.starts, window, rounds)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (stands[1:] != stands[:-1])
    at = np.flatnonzero(new)
    first = place[at]
    return Stretches(first, np.diff(np.append(at, len(place))), anchor[at], np.searchsorted(split.starts, first, side="right") - 1)


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... for n places, for each pair, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def first_equal(split: Split, place: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each window that begins at the words ``place``, the index of the first one with equal words.

    ``rank`` orders the windows; equal ranks are one window twice. Windows of equal hashes are compared word by word.
    """
    if not len(place):
        return np.zeros(0, np.int64)
    key = sequence_hashes(split.hashes, window, HASH_BASE)[place]
    by = np.lexsort((rank, key))
    same = key[by][1:] == key[by][:-1]
    at = np.flatnonzero(same)
    equal = np.ones(len(at), bool)
    for k in range(window):
        equal &= split.ids[place[by[at]] + k] == split.ids[place[by[at + 1]] + k]
    if not equal.all():  # other words under an equal hash: group by the words
        rows = np.lib.stride_tricks.sliding_window_view(split.ids, window)[place]
        key = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        by = np.lexsort((rank, key))
        same = key[by][1:] == key[by][:-1]
    head = np.ones(len(by), bool)
    head[1:] = ~same
    out = np.empty(len(by), np.int64)
    out[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    return out


def _documents(docs: DataFrame, body: Column | None = None) -> DataFrame:
    """(doc, ord, text), or ``body`` for the text: ord tells rows of one doc_id apart and is equal for equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("ord"), text.alias("text") if body is None else body)


def repeated_anchors(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, most: int = MOST) -> tuple[NameFilter, NameFilter]:
    """Filters of the anchors that more than one stretch has, and of those that more than ``most`` have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, n = np.unique(stretches(split_words(batch.column("text")), window, rounds).name, return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], names=["name", "n"])

    counted = docs.select("text").mapInArrow(lean(emit), "name long, n int").groupBy("name").agg(F.sum("n").alias("n"))
    again = written(counted.where("n > 1"), "names")
    filters = filter_of(again.select("name")), filter_of(again.where(F.col("n") > most).select("name"))
    drop(again)
    return filters


ROW = StructType([StructField(c, LongType()) for c in ("route", "doc", "ord", "start", "n")] + [StructField("words", StringType())])


def _rows(route, doc, order, start, n, words) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()]
    columns = [route.view(np.int64), doc, order, start, n, [w.decode() if w is not None else None for w in words]]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=ROW.names)


def _spans(doc: np.ndarray, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive starts of one document as (doc, ord, first start, number)."""
    by = np.lexsort((start, order, doc))
    doc, order, start = doc[by], order[by], start[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (order[1:] != order[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(doc)) - 1] if len(at) else start
    return doc[at], order[at], start[at], last - start[at] + 1


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, most: int = MOST) -> DataFrame:
    """(doc, ord, start, n) of ``docs(doc, ord, text)``: n consecutive window starts whose words also start earlier."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(repeated_anchors(docs, window, rounds, most))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, often = shared.value
        for batch in pieces(batches):
            split = split_words(batch.column("text"))
            all_ = stretches(split, window, rounds)
            kept = np.flatnonzero(again.may_hold(all_.name))
            if not len(kept):
                continue
            first, n, name, row = (x[kept] for x in (all_.place, all_.n, all_.name, all_.row))
            doc, order = (batch.column(c).to_numpy() for c in ("doc", "ord"))
            # Windows that an earlier one of the same piece repeats are settled here and sent as told.
            _, text_rank = np.unique(np.stack([doc, order], axis=1), axis=0, return_inverse=True)
            text_rank = text_rank.reshape(-1).astype(np.int64)
            of, at = np.repeat(np.arange(len(first)), n), _each(first, n)
            rank = text_rank[row[of]] << 32 | at - split.starts[row[of]]
            head = first_equal(split, at, rank, window)
            told = rank != rank[head]
            d, o, s, k = _spans(doc[row[of[told]]], order[row[of[told]]], (rank & 0xFFFFFFFF)[told])
            yield _rows(mix(d.view(U64) + s.view(U64)), d, o, s, k, [None] * len(d))
            # Of what is left a stretch sends its windows from the first to the last; a row twice is sent once.
            left = np.flatnonzero(head == np.arange(len(head)))
            many = often.may_hold(name[of[left]])
            whole, single = left[~many], left[many]
            lead = np.flatnonzero(np.diff(of[whole], prepend=-1))
            low, high = at[whole[lead]], at[whole[np.append(lead[1:], len(whole)) - 1]] if len(lead) else at[whole]
            low, high = np.concatenate([low, at[single]]), np.concatenate([high, at[single]]) + window
            by = np.concatenate([of[whole[lead]], of[single]])
            route = name[by]
            if len(single):
                route = route.copy()
                route[len(lead) :] = mix(route[len(lead) :] + sequence_hashes(split.hashes, window, HASH_BASE)[at[single]])
            yield _rows(route, doc[row[by]], order[row[by]], low - split.starts[row[by]], np.zeros(len(by), np.int64), split.texts(low, high))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by route, document and place: windows of a route whose words came before are repeats."""
        carry: pa.Table | None = None  # what the last route has brought so far, rows that repeat left out
        names = ["doc", "ord", "start", "n"]
        for batch in pieces(batches, "words", rows=1 << 20):
            told = batch.column("n").to_numpy() > 0
            if told.any():
                yield pa.record_batch([batch.column(c).filter(pa.array(told)) for c in names], names=names)
                batch = batch.filter(pa.array(~told))
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            before = 0
            if carry is not None and carry["route"][0] == own["route"][0]:
                before = len(carry)
                own = pa.concat_tables([carry, own])
            own = own.combine_chunks()
            route, doc, order, start = (own[c].to_numpy() for c in ("route", "doc", "ord", "start"))
            split = split_words(own["words"].chunk(0))
            size = np.diff(split.starts)
            of, at = np.repeat(np.arange(len(own)), size - window + 1), _each(split.starts[:-1], size - window + 1)
            place = start[of] + at - split.starts[of]
            # Rows are in order, so a window's rank is its place among them; a window of one text twice has one rank.
            head = first_equal(split, at, np.arange(len(at)), window)
            other = (doc[of] != doc[of[head]]) | (order[of] != order[of[head]]) | (place != place[head])
            found = other & (of >= before)
            if found.any():
                yield pa.record_batch(list(map(pa.array, _spans(doc[of[found]], order[of[found]], place[found]))), names=names)
            fresh = np.zeros(len(own), bool)
            fresh[of[head == np.arange(len(head))]] = True
            carry = own.filter(pa.array(fresh & (route == route[-1])))

    rows = docs.mapInArrow(lean(emit), ROW).repartition(width(spark), "route").sortWithinPartitions("route", "doc", "ord", "start")
    return rows.mapInArrow(lean(settle), "doc long, ord long, start long, n long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, rounds: int = ROUNDS, most: int = MOST) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without the words that a repeated window covers.

    Words lie between ASCII white space and are compared as they are. A window of ``window`` consecutive words is a
    repeat if its word sequence also starts at a smaller doc_id, or earlier in the same document; windows are judged
    on the input. Adds n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with ``texts``,
    kept_text (the text itself where no word goes) and removed (array of [first word, end) spans).

    A null or blank text has no words. Rows of one doc_id count as equal if their texts are equal: neither is earlier,
    and both keep what they alone share; of different texts one, fixed by a hash of the text, counts as earlier. A
    null doc_id counts as smallest. Every row gives a row, a text of any length is one row's work in one task; columns
    of ``docs`` with names of the added ones are replaced, others are kept whatever their names. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = _documents(docs)
    found = repeats(own, window, rounds, most).groupBy("doc", "ord").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    found = written(found, "spans")
    made = ["n_words", "n_removed", "kept_sha256", *["kept_text", "removed"] * texts]
    kept = [c for c in docs.columns if c not in made]
    key, rows = ["doc", "ord"], _documents(docs, as_rows(docs, kept))
    # Texts that nothing touches stay where they are; only the others are dealt out to meet their spans.
    may = may_hold(rows, filter_of(found.select(F.xxhash64(*key).alias("name"))), F.xxhash64(*key))
    met = rows.where(may).join(found, key, "left").select("row", "spans")
    plain = rows.where(~may).select("row", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column("row")
            lists = batch.column("spans")
            bounds = lists.offsets.to_numpy()
            start, n = (lists.values.field(k).to_numpy() for k in ("start", "n"))
            out: dict[str, list] = {c: [] for c in made}
            for i, text in enumerate(body.field(kept.index("text")).to_pylist()):
                words = (text or "").encode().split()
                a, b = (int(bounds[i]), int(bounds[i + 1])) if lists[i].is_valid else (0, 0)
                gone, left = np.zeros(0, bool), words
                if a < b:
                    covered = np.zeros(len(words) + 1, np.int32)
                    np.add.at(covered, start[a:b], 1)
                    np.add.at(covered, np.minimum(start[a:b] + n[a:b] + window - 1, len(words)), -1)
                    gone = np.cumsum(covered[:-1]) > 0
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                plain = b" ".join(left)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept_sha256"].append(hashlib.sha256(plain).hexdigest())
                if texts:
                    out["kept_text"].append(plain.decode() if len(left) < len(words) else text)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    out["removed"].append(edge.reshape(-1, 2).tolist())
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "removed": pa.list_(pa.list_(pa.int64()))}
            yield pa.record_batch([*body.flatten(), *(pa.array(out[c], types.get(c, pa.string())) for c in made)], names=[*kept, *made])

    types = {"n_words": LongType(), "n_removed": LongType(), "removed": ArrayType(ArrayType(LongType()))}
    schema = StructType([*rows.schema["row"].dataType] + [StructField(c, types.get(c, StringType())) for c in made])
    return met.unionByName(plain).mapInArrow(lean(run), schema)
