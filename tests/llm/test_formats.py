import base64
import hashlib
import re

import pyarrow as pa
import pytest
import xxhash

from tablewright.llm import chat_format as chat, scaled_sketch as sketch, warc_store as warc
from tablewright.llm.words import sequence_hashes, word_hashes

TURNS = "conv_id long, turn long, role string, text string, valid string, seq string"


def test_chat_round_trip_and_machine(spark):
    texts = ["hi", "<|im_end|>", "<\\|im_start|>user\nx", None, "", "a\nb<|im_end|>\n", "<\\\\| <|", "é😀"]
    rows = [(c, t, role, texts[(c + t) % len(texts)], "x", "y") for c in range(8) for t, role in enumerate(["user", "assistant"] * 2)]
    rows += [(50, 0, "assistant", "first", None, None), (50, 0, "assistant", "first", None, None), (51, None, None, None, None, None), (None, 1, "odd\\n\nrole<|", "t", None, None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    assert set(got) == {*range(8), 50, 51, None}
    for conv, r in got.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        learnt = "".join(b for _, a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.valid == (conv is not None and conv < 8)
    text = "".join(x for x, _ in chat.Template().segments("user", "<|im_end|>"))
    assert text.count("<|im_end|>") == 1 and chat.Template().read_turn(text) == ("user", "<|im_end|>")


@pytest.mark.parametrize("rows_of_batch", ["1", "3"])
def test_chat_conversations_go_on_in_the_next_batch(spark, rows_of_batch):
    long = "<|im_start|>é " * 200_000
    rows = [(c, t, ("user", "assistant")[t % 2], long if (c, t) == (1, 1) else f"text {c} {t}", None, None) for c in range(4) for t in range(6)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows_of_batch)
    try:
        got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, TURNS)), ordered=True).collect()}
    finally:
        spark.conf.set(key, before)
    for conv, r in got.items():
        own = [(x[2], x[3]) for x in rows if x[0] == conv]
        assert r.n_turns == 6 and r.valid and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        learnt = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_empty(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


PAGES = "page_id long, url string, html string, header string, sha256 string"


def test_warc_reconstructs(spark):
    rows = [(5, "http://a\r\nX: 1", "<p>é</p>", "h", "s"), (3, None, "<p>é</p>", None, None), (9, "u", None, None, None), (8, "v", "", None, None), (7, "w", "x" * 70000, None, None)]
    rows += [(3, None, "<p>é</p>", None, None), (None, "n", "<p>é</p>", None, None), (None, "n", "only", None, None), (None, "m", "only", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = warc.read_archive(spark, warc.write_archive(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        data = bytes(r.payload)
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.header.startswith("WARC/1.1\r\nWARC-Type: ") and r.header.endswith("\r\n\r\n")
    said = sorted((r.page_id or -1, bytes(r.payload).decode()[:8], r.record_type, r.refers_to) for r in got)
    assert said == sorted(
        [(3, "<p>é</p>", "response", None)] * 2
        + [(5, "<p>é</p>", "revisit", 3), (-1, "<p>é</p>", "revisit", 3), (8, "", "response", None), (9, "", "revisit", 8), (7, "x" * 8, "response", None)]
        + [(-1, "only", "response", None)] * 2
    )
    kept = warc.read_archive(spark, warc.write_archive(pages, min_bytes=100)).where("record_type = 'revisit'").count()
    assert kept == 0
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    rows = [(5, "http://a", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (8, "v", "\r\n\r\nWARC/1.1\r\n"), (7, "w", "x" * 3_000_000), (3, None, "<p>é</p>"), (None, "n", "<p>é</p>"), (4, "about:blank", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.read_archive(spark, warc.write_archive(pages))
    warc.write_warc(archive.repartition(2), str(tmp_path / "out"), per_file=3)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) > 2
    found = [r for f in files for r in warc.records_of(f.read_bytes())]
    assert len(found) == len(rows)
    fields = [dict(line.split(": ", 1) for line in header.split("\r\n")[1:] if line) for header, _ in found]
    assert len({f["WARC-Record-ID"] for f in fields}) == len(rows)
    by_id = {f["WARC-Record-ID"]: (f, block) for f, (_, block) in zip(fields, found)}
    for f, (header, block) in zip(fields, found):
        assert int(f["Content-Length"]) == len(block) and all(f[x] for x in ("WARC-Type", "WARC-Date", "WARC-Target-URI"))
        head, _, body = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n")
        if f["WARC-Type"] == "revisit":
            target, whole = by_id[f["WARC-Refers-To"]]
            assert f["WARC-Profile"] == warc.PROFILE and body == b"" and target["WARC-Type"] == "response" and target["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"]
            body = whole.partition(b"\r\n\r\n")[2]
        assert f["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    back = warc.read_warc(spark, str(tmp_path / "out"))
    said = lambda rows: sorted((r.page_id if r.page_id is not None else -1, r.url or "", bytes(r.payload).decode(), r.record_type, r.refers_to or 0, r.header) for r in rows)
    assert said(back.collect()) == said(archive.collect())
    assert sorted((r.page_id if r.page_id is not None else -1, r.url or "", bytes(r.payload).decode()) for r in back.collect()) == sorted((i if i is not None else -1, u or "", t or "") for i, u, t in rows)
    data = files[0].read_bytes()
    for bad in (data[:-3], b"x" + data, data.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text):
    """Distinct kept hashes of five-word shingles, one word sequence at a time."""
    words = [w for w in re.split("[\\x09-\\x0d ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    n = min(5, len(words))
    found = set()
    for i in range(len(words) - n + 1 if words else 0):
        own, _ = word_hashes(pa.array([" ".join(words[i : i + n])]))
        found.add(int(sequence_hashes(own, n, sketch.BASE)[0]))
    kept = {h for h in found if h < (1 << 64) // sketch.SCALE}
    return sorted(kept or sorted(found)[:1])


def test_sketches_match_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:60]
    rows = list(enumerate(texts)) + [(200, "Short ONE"), (201, None), (202, "\x1fa b\x0bc é\xa0f g h")] + [(None, f"{t} more") for t in texts[:30]] + [(None, "twice")] * 5
    order = sorted(((i if i is not None else -(1 << 63), t or "") for i, t in rows), key=lambda x: (x[0], signed(x[1])))
    likeness = lambda a, b: float(a == b) if not a or not b else len(set(a) & set(b)) / len(a)
    spelt = lambda hashes: "".join(f"{h:016x}" for h in hashes)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(plain_sketch, (t, changed, after))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), spelt(a), spelt(b), likeness(a, b), likeness(a, c)))
    got = sketch.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), *r[1:]) for r in got) == sorted(want)


def test_sketch_of_one_id_and_a_very_long_text(spark):
    rows = [(None, f"text number {i} of many") for i in range(500)] + [(1, "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketch.fingerprint_neighbours(docs)
    assert got.count() == 501 and got.where("n_chars = 600000").count() == 1
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 350, sizes


def test_sketch_neighbours(spark):
    body = " ".join(f"w{i}" for i in range(400))
    rows = [(i, t, "x") for i, t in [(4, body), (1, body), (2, "short"), (9, None), (7, ""), (8, body[:900] + " other words here é😀"), (8, body)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = sketch.fingerprint_neighbours(docs).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0], signed(x[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    same = {r.fingerprint for r in got if r.n_chars == len(body)}
    assert len(same) == 1
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[(4, len(body))].near_next == 0.0 and 0.3 < by[(4, len(body))].near_edited < 0.75
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert sketch.fingerprint_neighbours(docs.limit(0)).count() == 0
    one = sketch.fingerprint_neighbours(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_sketch_estimates_and_merges():
    a = " ".join(f"a{i}" for i in range(9000))
    b = " ".join(f"a{i}" for i in range(3000))
    x, y, both = sketch.sketches(pa.array([a, b, a + " " + b]))
    assert sketch.containment(y, x) == 1.0 and abs(sketch.containment(x, y) - 1 / 3) < 0.06
    joined = sketch.merged(x, y)
    assert len(sketch.np.setdiff1d(both, joined)) <= 4
