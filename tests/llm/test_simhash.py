import re

import numpy as np
import pytest
import xxhash

from tablewright.llm import simhash
from tablewright.llm.components import components


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def classes(fps, threshold):
    up = {i: i for i in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= threshold:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_near_duplicates_match_brute_force(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in base] + [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "Ab cD", "x"), (904, "aB Cd", "x"), (905, "é\xa0a b c d", "x")]
    rows += [(910 + k, base[k].text + " more", "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute(t) for i, t, _ in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == classes(fps, 4)


def test_links_miss_nothing(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(8):
            x = s
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    want = classes(dict(enumerate(fps)), 4)
    for wide in (False, True):
        links = components(simhash.links(spark.createDataFrame(signed, "fp long"), wide=wide)).collect()
        root = {i: i for i, in signed} | {r.id: r.root for r in links}
        mine, theirs = {}, {}
        for k, (i,) in enumerate(signed):
            mine.setdefault(root[i], set()).add(k)
            theirs.setdefault(want[k], set()).add(k)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_large_anchor_is_filed_again(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    plain = simhash.forest_links(x, y, 4)
    monkeypatch.setattr(simhash, "DIRECT", 10)
    assert {frozenset(p) for p in simhash.forest_links(x, y, 4)} == {frozenset(p) for p in plain} and len(plain) == 300


def test_components_of_a_path_and_empty(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3), (5, 5)], "a long, b long")
    assert {(r.id, r.root) for r in components(links).collect()} == {(i, 0) for i in range(201)}
    assert components(links.limit(0)).count() == 0


def test_edge_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 4), (4, 4), (4, 4)]
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), threshold=3)


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_groups_of_alike_texts(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, "x") for r in base]
    rng = np.random.default_rng(3)
    for k in range(60):
        words = base[k % 6].text.split()
        for i in rng.choice(len(words), max(1, len(words) // 60), replace=False):
            words[i] = f"new{k}{i}"
        rows.append((1000 + k, " ".join(words), "x"))
    rows += [(2000, None, "x"), (2001, " ", "x"), (None, base[0].text, "x"), (3, base[3].text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class string")
    big = 10**9  # the row without an id
    own = [(i if i is not None else big, t) for i, t, _ in rows]
    up = {i: i for i, _ in own}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(own):
        for j, b in own[:n]:
            if jaccard(a, b) >= 0.8 and find(i) != find(j):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    want = {(i, find(i)) for i, _ in own}
    assert {(r.doc_id if r.doc_id is not None else big, r.component_id) for r in simhash.alike_groups(docs).collect()} == want
    monkeypatch.setattr(simhash, "MEMBERS", 7)
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x for x, y in want if x == y)
    assert kept.columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_rows_without_ids_and_with_shared_ids(spark):
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text.split()) > 60][:6]
    rows = [(None, base[0]), (None, base[0]), (None, base[1]), (5, base[1]), (7, base[2]), (7, base[3]), (7, base[3]), (9, base[3] + " end"), (None, ""), (None, None), (None, base[4] + " x"), (None, base[4])]
    docs = spark.createDataFrame([(i, t, "r", "s") for i, t in rows], "doc_id long, text string, `a.b` string, same string")
    got = simhash.keep_one(docs).collect()
    assert all((r["a.b"], r.same) == ("r", "s") for r in got)
    said = [(r.doc_id, (r.text or "").strip()) for r in got]
    assert sorted(x for x in said if x[0]) == sorted([(5, base[1]), (7, base[2]), (7, base[3])])
    nameless = [t for i, t in said if not i]
    assert len(nameless) == 3 and base[0] in nameless and "" in nameless and any(t.startswith(base[4]) for t in nameless)


def test_equal_nibbles_are_counted():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 1 << 32, (30, simhash.BANDS * simhash.ROWS), dtype=np.uint64).astype(np.uint32)
    rows[1] = rows[0]
    words = [w.view(np.int64) for w in simhash._nibbles(rows)]
    got = simhash._equal_nibbles(words, 0, np.arange(30))
    assert got.tolist() == [int(((rows[0, :32] ^ r[:32]) & 15 == 0).sum()) for r in rows]


def test_block_edits_are_linked(spark):
    base = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text]
    base = list({" ".join(w[:400]).lower(): w[:400] for w in base if 60 <= len(w)}.values())[:200]
    rows, pairs = [], []
    for k, words in enumerate(base):
        own = [f"own{k}x{i}" if i % 12 == 0 else w for i, w in enumerate(words)]
        more = [f"more{k}x{i}" for i in range(len(own) // 6)]
        for n, other in enumerate((own[: len(own) * 84 // 100], own + more, more[: len(more) // 2] + own[len(more) // 2 :])):
            if 0.8 <= jaccard(" ".join(own), " ".join(other)) <= 0.87:
                rows.append((1000 + 10 * k + n, " ".join(other)))
                pairs.append((10_000 + k, rows[-1][0]))
        rows.append((10_000 + k, " ".join(own)))
    assert len(pairs) > 300
    got = {r.doc_id: r.component_id for r in simhash.alike_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 9000, 150_000))
    rows = [(3, text), (1, text + " tail"), (2, "short one"), (4, text[: len(text) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == {i: brute(t) for i, t in rows} and got[3].component_id == 1
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2, 4]
