import random
import re
import zlib
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from tablewright.llm import license_scan as scan, quality_knn as knn


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for label, phrase in scan.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_base_phrases_match_brute_force(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000 + i, t, "x") for i, t in enumerate([None, "", "Apache-License, MIT\x00license; cc/by cc by", "éapache license", "the GNU general public license apache license" * 3, "cc cc by by", "licensed under cc by nc 4", "gnu general public licenses"])]
    got = {r.doc_id: r for r in scan.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        n, found = brute(text)
        r = got[i]
        places = [p for p, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(places, default=None), max(places, default=None)), text
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_notices_by_relative_position(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this package"
    rows = [(1, "x y " + mit, 0), (2, "free of charge permission is granted to any person", 0), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted", 0), (3, "Licensed under CC BY-NC 4.0.", 0)]
    got = scan.scan(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id, r.labels) for r in got) == [(1, "mit"), (2, ""), (3, "bsd"), (3, "cc-by,cc-by-nc")]
    assert scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_labels(text, templates):
    """Labels and best share by looking at every place where a key phrase stands."""
    words, labels, best = scan.words_of(text), set(), 0.0
    for t in templates:
        n, size = len(t.key), len(t.words)
        for key in range(len(words) - n + 1):
            if tuple(words[key : key + n]) != t.key:
                continue
            start = key - t.key_at
            agree = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words))
            if agree < t.share * size:
                more, after = size // 10, t.key_at + n
                sides = ((t.words[: t.key_at], words[max(0, start - more) : key]), (t.words[after:], words[start + after : start + size + more]))
                agree = n + sum(b.size for a, w in sides for b in SequenceMatcher(None, a, w, autojunk=False).get_matching_blocks())
            if agree >= t.share * size:
                labels.add(t.label)
                best = max(best, agree / size)
    return ",".join(sorted(labels)), best


def changed(words, keep, rng, share):
    out = []
    for i, word in enumerate(words):
        kind = rng.choice("sid") if i not in keep and rng.random() < share else ""
        out += {"": [word], "s": [b"other"], "i": [word, b"more"], "d": []}[kind]
    return out


def test_labels_and_scores_match_brute_force(spark):
    rng, found = random.Random(6), scan.templates()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in found * 4:
        keep = range(t.key_at, t.key_at + len(t.key))
        texts.append(b" ".join([b"pad"] * rng.randint(0, 9) + changed(t.words, keep, rng, rng.choice((0, 0.1, 0.3))) + [b"end"] * rng.randint(0, 3)).decode())
    texts += ["license " * 5000 + " ".join(scan.NOTICES[0][1].split()), " ".join(w for _, w, _ in scan.TEXTS)]
    got = {r.doc_id: r for r in scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(bool(r.labels) for r in got.values()) > 100
    for i, text in enumerate(texts):
        assert (got[i].labels, got[i].score) == brute_labels(text, found), text


def test_recall_of_changed_licences():
    rng, found = random.Random(8), scan.templates()
    index, hits = scan.Index(found, {}, 1), Counter()
    for t in found:
        for _ in range(0 if t.base else 40):
            words = changed(t.words, range(t.key_at, t.key_at + len(t.key)), rng, 0.1)
            hits[t.label in {h[0] for h in index.scan([b"pad"] * rng.randint(0, 30) + words + [b"end"])}] += 1
    assert hits[True] / hits.total() > 0.97
    # Whole texts of one licence aren't taken for another.
    own = {label: {h[0] for h in index.scan(scan.words_of(text)) if not h[3]} for label, text, _ in scan.TEXTS}
    assert all(labels <= {label, label.split("-")[0]} for label, labels in own.items())


def test_votes_match_brute_force():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["sun", "Moon", "a1", "--", "#!", "tide"], rng.integers(0, 60))) for _ in range(160)]
    counts = knn.term_counts(pa.array(texts))
    labels = (np.arange(120) % 3 > 0).astype(np.float32)
    model = knn.fit(counts[:120], labels, dimensions=12)
    got = model.scores(counts[100:])
    for text, score in zip(counts[100:], got):
        x = np.sqrt(text.astype(np.float64)) * model.idf
        z = (x / max(np.linalg.norm(x), 1e-12)) @ model.space.astype(np.float64)
        z = z / max(np.linalg.norm(z), 1e-12)
        near = sorted(((-round(float(z @ v), 5), i) for i, v in enumerate(model.vectors.astype(np.float64))))[: knn.NEIGHBOURS]
        weight = [max(-c, 0) ** 8 for c, _ in near]
        want = sum(w * labels[i] for w, (_, i) in zip(weight, near)) / sum(weight) if sum(weight) > 1e-9 else labels.mean()
        assert abs(score - want) < 2e-3
    assert np.allclose(model.scores(counts[100:101]), got[:1], atol=1e-3) and np.allclose(model.scores(counts[120:]), got[20:], atol=1e-3)


def test_quality_with_text_ids_repeats_and_odd_columns(spark):
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)] + [("d0", 1), ("d0", None)], "doc_id string, quality int")
    good, bad = "The tide came in over the flats and the boats rose. ", "### buy |||| now !!!! $$$$ "
    rows = [(f"d{i}", (good if i % 2 or not i else bad) * (1 + i % 5), "p", "q") for i in range(60)] + [("d1", good * 3, "p", "q")] * 50
    docs = spark.createDataFrame(rows, "doc_id string, text string, `a.b` string, predicted string")
    model = knn.fit_on(docs, labels)
    assert len(model.labels) <= 61
    got = knn.score(docs, model).collect()
    assert len(got) == 110 and all(r["a.b"] == "p" for r in got)
    assert all(r.predicted == (r.text.startswith("The")) for r in got)
    long = spark.createDataFrame([("d1", good * 60_000)], "doc_id string, text string")
    assert knn.score(long, model).first().predicted == 1


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = knn.fit_on(docs, labels)
    told = {r.doc_id: r.quality for r in labels.collect()}
    got = knn.score(docs.select("doc_id", "text").withColumn("held_out", knn.held_out(docs.doc_id)), model).drop("text").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and r.doc_id in told]
    assert sum(r.predicted == told[r.doc_id] for r in judged) / len(judged) > 0.97
    # Each label for itself: most are 1.
    for label in (0, 1):
        own = [r.predicted == label for r in judged if told[r.doc_id] == label]
        assert sum(own) / len(own) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "Some text here.", "c"), (1, "x", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = knn.score(docs, knn.fit_on(docs, own)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert knn.score(docs.limit(0), knn.fit_on(docs.limit(0), labels)).count() == 0
