"""Packed lengths are the encoder's."""

import corpus_pipeline
from tessera.llm import bpe, packing, queries


def test_lengths_are_counted_over_whole_texts(spark, tmp_path):
    long = "Längere Wörter, and more words. " * 2000
    texts = [(1, "Hello world, it's 42!"), (2, None), (3, ""), (4, long), (1, "Hello world, it's 42!"), (None, "no id"), (5, "El niño comió piñas según él.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want: dict = {}
    for i, t in texts:
        want[i] = want.get(i, 0) + len(bpe.codec().encode([t or ""])[0]) // 4
    for out in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))):
        got: dict = {}
        for r in out.collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
            assert r.token_start + r.n_tokens <= packing.CAPACITY
        assert got == want


def test_counts_are_those_of_the_encoder(monkeypatch):
    texts = [None, "", " ", "a new word", "anew  words 123,456!", "naïve \U0001f600 x", "a new word", "a" * 300]
    want = [len(x or b"") // 4 for x in bpe.Codec().encode(texts)]
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c = bpe.Codec()
    assert c.count(texts) == c.count(texts) == want
    assert [c.count([t])[0] for t in texts] == want and c.count([]) == []


def test_only_unknown_words_are_looked_up_twice(monkeypatch):
    class Counted(bpe.Sizes):
        looked = 0

        def __getitem__(self, word):
            Counted.looked += 1
            return super().__getitem__(word)

    texts = ["some words that come again " * 50, "some words that come again and a new one"]
    want = [len(x) // 4 for x in bpe.Codec().encode(texts)]
    c = bpe.Codec()
    c.sizes = Counted()
    assert c.count(texts[:1]) == want[:1]
    Counted.looked = 0
    assert c.count(texts) == want
    assert Counted.looked <= sum(len(c.split(t)) for t in texts) + 4
