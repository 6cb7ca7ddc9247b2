import random

import numpy as np
import pytest

from tablewright.llm import decontaminate as d


def plain_tiles(item, text, least):
    """Greedy tiling by its definition: repeatedly the longest unmarked common sequence."""
    item, text, covered = list(item), list(text), 0
    free_i, free_t = [True] * len(item), [x >= 0 for x in text]
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and free_i[i + k] and free_t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        covered += k
        free_i[i : i + k] = [False] * k
        free_t[j : j + k] = [False] * k


def test_tiles_cover_what_plain_tiling_covers():
    rng = np.random.default_rng(3)
    for n in range(150):
        item = rng.integers(0, 4 if n % 2 else 40, rng.integers(1, 50))
        parts = [item[a : a + rng.integers(3, 20)] for a in rng.integers(0, len(item), 5)]
        text = np.concatenate([*parts, rng.integers(0, 40, 10), [-1], item[:7]])
        least = min(5, len(item))
        laid = d.tiles(item.astype(np.int64), text.astype(np.int64), least)
        assert all((item[i : i + k] == text[j : j + k]).all() and k >= least for i, j, k in laid)
        assert len({x for i, _, k in laid for x in range(i, i + k)}) == sum(k for _, _, k in laid)
        assert sum(k for _, _, k in laid) == plain_tiles(item, text, least)


def test_reordered_passages_and_clean_documents(spark):
    rng = random.Random(1)
    word = lambda k: f"w{k}"
    items = [(i, " ".join(word(rng.randint(0, 900)) for _ in range(40)), "x") for i in range(30)] + [(100, "Short one.", "x"), (101, None, "x"), (102, "", "x"), (7, "again again", "x")]
    docs = []
    for i in range(30):
        words = items[i][1].split()
        parts = [words[k : k + 10] for k in range(0, 40, 10)]
        rng.shuffle(parts)
        noise = [" ".join(word(rng.randint(901, 2000)) for _ in range(30)) for _ in range(5)]
        docs.append((i, " ".join(noise[k] + " " + " ".join(parts[k]).upper() + "!" for k in range(4)), "t"))
        docs.append((1000 + i, " ".join(word(rng.randint(0, 900)) for _ in range(400)), "t"))
    docs += [(2000, None, "t"), (2001, "", "t"), (2002, "a SHORT, one b", "t"), (None, items[3][1], "t"), (5, docs[10][1], "t")]
    frames = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    want = sorted([(i, i) for i in range(30)] + [(5, 5), (2002, 100), (-1, 3)])
    for size in (d.BLOCK_CHARS, 900):
        got = d.contaminated(*frames, block_chars=size).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in got) == want
        assert all(r.coverage == 1.0 for r in got)
    assert d.contaminated(frames[0].limit(0), frames[1]).count() == 0
    assert d.contaminated(frames[0], frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("block_chars", [d.BLOCK_CHARS, 100])
def test_ids_of_text_and_a_very_long_text(spark, block_chars):
    words = [f"w{i}" for i in range(40)]
    long = " ".join(f"x{i % 70_000}" for i in range(300_000)) + " " + " ".join(words)
    docs = spark.createDataFrame([("a", " ".join(words)), ("a", " ".join(words)), (None, long), ("c", "w1 w2 w3")], "doc_id string, text string")
    items = spark.createDataFrame([("i", " ".join(words[:20])), (None, " ".join(words[20:])), ("j", "nothing of the kind in any text")], "item_id string, text string")
    got = sorted((r.doc_id or "", r.item_id or "", r.tiled_words, r.coverage) for r in d.contaminated(docs, items, block_chars=block_chars).collect())
    assert got == sorted([(x, i, 20, 1.0) for x in ("a", "a", "") for i in ("i", "")])


def test_planted_items_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    plain = {r.item_id: " ".join(d.words_of(r.text)) for r in items.collect()}
    whole = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for t in [" ".join(d.words_of(r.text))] for i, x in plain.items() if x in t}
    assert whole <= got and len(got) < len(whole) * 1.05 + 3
