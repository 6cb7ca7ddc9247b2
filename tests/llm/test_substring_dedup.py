import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tablewright.llm import substring_dedup as dedup
from tablewright.llm.words import word_hashes


def order_of(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, window=20):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256); equal rows count as one document."""
    docs = sorted({(i if i is not None else -(1 << 63), order_of(t), tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows})
    seen, result = set(), {}
    for i, order, words in docs:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            own = words[s : s + window]
            if own in seen:
                gone[s : s + window] = [True] * window
            seen.add(own)
        left = " ".join(w for w, g in zip(words, gone) if not g)
        result[i, order] = (len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return sorted((i if i is not None else -1, *result[i if i is not None else -(1 << 63), order_of(t)]) for i, t in rows)


def check(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(5)
    got = dedup.remove_repeats(docs, **more).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, more.get("window", 20))
    return got


def test_tables_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert sum(r.n_removed for r in got) > 1000
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        if not by[i].n_removed:
            assert by[i].kept_text == text and by[i].removed == []
        else:
            assert sum(b - a for a, b in by[i].removed) == by[i].n_removed


def test_periods_runs_and_shared_passages(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(120):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60))]
        kind = i % 8
        if kind == 0:
            words += ["z"] * rng.randint(15, 45)
        elif kind == 1:
            words += [f"q{k % rng.randint(1, 9)}" for k in range(60)]
        elif kind == 2:
            k = rng.randint(0, 45)
            words[5:5] = passage[k : k + rng.randint(15, 50)]
        elif kind == 3:
            p = rng.randint(2, 13)
            words += [f"r{k % p}" for k in range(rng.randint(19, 60))]
        elif kind == 4:
            words = (passage[:30] + ["z"] * 25 + passage[10:40]) * 2
        rows.append((i * 3 % 97 * 10 + i // 97, " ".join(words)))
    check(spark, rows)
    check(spark, rows, window=7)
    check(spark, rows, most=1)
    check(spark, rows, rounds=6)


def test_edge_rows(spark):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, body), (4, body), (5, "x " + body + "\x0b y"), (6, body), (6, body), (6, "other " + body), (7, "too short"), (7, "é\xa0é " * 30), (8, ("é\xa0é " * 30).strip())]
    got = check(spark, rows)
    assert {r.kept_text for r in got if r.doc_id == 4} == {""}
    assert dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("window", [5, 20])
def test_equal_windows_have_equal_anchors(window):
    rng = np.random.default_rng(2)
    core = rng.integers(0, 30, 200)
    texts = [" ".join(map(str, np.concatenate([rng.integers(0, 30, rng.integers(0, 40)), core, rng.integers(0, 30, 10)]))) for _ in range(20)]
    words, starts = word_hashes(pa.array(texts))
    place, anchor, stands = dedup.anchors(words, starts, window)
    seen = {}
    for p, *a in zip(place.tolist(), anchor.tolist(), (stands - place).tolist()):
        assert seen.setdefault(tuple(words[p : p + window].tolist()), a) == a
    assert len(set(anchor.tolist())) > 50


def test_rounds_tell_repeats_from_unique_texts(spark):
    rng = np.random.default_rng(9)
    unique = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(60)]
    split = dedup.split_words(pa.array(unique))
    found = dedup.stretches(split, 20, dedup.ROUNDS)
    # A few words in a row name a stretch of about eight windows, and names of unique texts hardly ever repeat.
    assert 0.08 < len(found.n) / len(split.ids) < 0.2 and found.n.sum() == 60 * 381
    docs = spark.createDataFrame(list(enumerate(unique)), "doc_id long, text string")
    again, often = dedup.repeated_anchors(dedup._documents(docs))
    assert again.may_hold(found.name).mean() < 0.05
    again, often = dedup.repeated_anchors(dedup._documents(docs.unionByName(docs.selectExpr("doc_id + 100", "text").toDF("doc_id", "text"))))
    assert again.may_hold(found.name).all()


def test_dotted_columns_and_a_very_long_text(spark):
    body = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"x{i % 90_000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, body, "p", 7), (2, f"y {body} z", "q", 8), (3, long, "r", 9)], "doc_id long, text string, `a.b` string, `doc` int").withColumnRenamed("doc", "spa`ns")
    got = {r.doc_id: r for r in dedup.remove_repeats(docs).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 30, 110_000] and got[2].kept_text == "y z" and got[3]["a.b"] == "r" and got[3]["spa`ns"] == 9
    assert got[3].removed == [[90_000, 200_000]]


def test_equal_hashes_of_other_words_are_told_apart(monkeypatch):
    split = dedup.split_words(pa.array(["a b c d", "a b c e", "a b c d"]))
    monkeypatch.setattr(dedup, "sequence_hashes", lambda words, window, base: np.zeros(len(words) - window + 1, np.uint64))
    assert dedup.first_equal(split, np.array([0, 4, 8]), np.arange(3), 4).tolist() == [0, 1, 0]
