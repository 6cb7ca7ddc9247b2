import hashlib

import corpus_pipeline as pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tablewright.llm import decontaminate

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """doc_id -> smallest doc_id of its group of five-word shingle Jaccard 0.8 and more."""
    up = {i: i for i in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = {i: shingles(t) for i, t in rows.items()}
    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = sets[i] | sets[j]
            if not both or len(sets[i] & sets[j]) >= 0.8 * len(both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def without_repeats(rows, window=20):
    seen, out = set(), {}
    for i in sorted(rows):
        words = (rows[i] or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            if own in seen:
                gone[s : s + window] = [True] * window
            seen.add(own)
        out[i] = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else rows[i]
    return out


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = pipeline.quality(spark, docs, SF)
    assert first.columns == docs.columns
    rows = {r.doc_id: r.text for r in first.collect()}
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {i for i in rows if i in told} == {i for i, q in told.items() if q == 1}
    root = groups(rows)
    rows = {i: t for i, t in rows.items() if root[i] == i}
    rows = without_repeats(rows)
    items = [" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in " ".join(decontaminate.words_of(t)) for x in items)}
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows) and {i: r.text for i, r in got.items()} == rows
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in got.items():
        ids = library.encode(rows[i], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_an_empty_table_with_more_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 as score", "'x' as gone", "'y' as n_words")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_columns_of_the_input_stay_and_rows_without_ids_are_judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = spark.createDataFrame([(None, item, "en", "s", 1), (1, item, "en", "s", 1), (None, None, "en", "s", 0)], docs.schema)
    named = docs.unionByName(odd).selectExpr("*", "'mine' as predicted", "'mine' as n_words", "'mine' as same", "'mine' as `a.b`")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, named, SF)
        assert got.columns == named.columns
        kept = got.collect()
        assert kept and all(r[c] == "mine" for r in kept for c in ("predicted", "n_words", "same", "a.b")), name
        if name == "decontamination":
            assert item not in {r.text for r in kept} and any(r.text is None for r in kept) and any(r.doc_id == 1 for r in kept)
