import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm import bpe_codec, token_counts

PIECES = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "1", "\xa0", "!", "<|endoftext|>", "<|startoftext|>", "\x1c", "the", "ing", "ß", "́", "​", "\r\n", "中", "\x00", "\x85", "İ", "😀"]


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    return out + ["", None, "a" * 5000, "ab" * 3000, "I'm we'LL 123", " trailing ", "x\n  b", "<|EndOfText|>", "x y" * 2000]


def test_counts_match_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, "a", "n"), (0, "a", "n"), (0, "a", "n")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id}
    for i, t, _ in rows:
        if i:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (by[i].n_tokens, by[i].n_bytes, by[i].over_limit) == (n, len((t or "").encode()), n > 1024), t


def test_codec_matches_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t, "n") for i, t in enumerate(texts())]
    got = bpe_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("f, name", [(bpe_codec.encode_decode, "word_bpe_49k.json"), (token_counts.token_counts, "byte_bpe_50k.json")])
def test_empty(spark, f, name):
    assert f(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path(name)).count() == 0


def test_other_vocabularies_are_refused():
    for make, name in ((bpe_codec.Codec, "byte_bpe_50k.json"), (token_counts.Counter, "word_bpe_49k.json")):
        with pytest.raises(ValueError, match="cuts texts in another way"):
            make(public_tokenizers.path(name))


def test_memory_is_bounded_and_forgotten():
    codec = bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.known.most = 20_000
    text = " ".join(f"w{i}ord" for i in range(3000))
    ids = codec.encode(text)
    assert codec.known.size <= 10_000 and len(codec.known.before) <= 60 and ids == Tokenizer.from_file(codec.path).encode(text, add_special_tokens=False).ids
    codec.known.forget()
    assert not codec.known and not codec.known.before and codec.known.size == 0


def test_dotted_columns_and_a_very_long_text(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "One two, three! " * 200_000
    docs = spark.createDataFrame([(1, text, "p", "q")], "doc_id long, text string, `a.b` string, `n_tokens` string").withColumnRenamed("n_tokens", "we`ird")
    row = bpe_codec.encode_decode(docs, path).first()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert row.ids == ids and row["a.b"] == "p" and row["we`ird"] == "q"
