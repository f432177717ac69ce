"""Edges found by review: null ids of the scoring model, memory of texts with many unknown words."""

import random
import time
import resource

import numpy as np
import public_tokenizers

from lambdalake.llm import bpe, html, scoring


def test_null_ids_are_scored(spark):
    rows = [(i, f"a b c {i}") for i in range(20)] + [(None, "a b c"), (None, "x y"), (0, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = scoring.score(docs).collect()
    assert sum(r.doc_id is None for r in got) == 2 and all(not r.held_out for r in got if r.doc_id is None)
    known = [r for r in got if r.doc_id is None and r.n_tokens == 4]
    same = [r for r in got if r.doc_id == 0 and r.n_tokens == 4]
    assert known[0].score == same[0].score and known[0].train_tokens == sum(r.n_tokens for r in got if not r.held_out)


def test_many_unknown_words(monkeypatch):
    """Merging in groups gives the same ids, and its memory does not grow with the number of words."""
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("qxzjkvwy", k=rng.randint(3, 60))) for _ in range(60_000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    encoder = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids, _ = encoder.encode(data, offsets)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    monkeypatch.setattr(bpe.Vocabulary, "TOGETHER", 7777)
    assert np.array_equal(ids, encoder.encode(data, offsets)[0])
    assert grown < 60 + 40 * len(text) / 1e6, grown


def test_pages_of_any_make_are_read_in_linear_time():
    """Quotes and comments that stay open, closing tags of nothing, elements a hundred thousand deep."""
    for make in ('<a "', "<b '", '<a ">\'', "<!", "</script", "<p></b>", "<div><p></x>", "<"):
        began = time.process_time()
        html.blocks(make * (1_000_000 // len(make)))
        assert time.process_time() - began < 5, make
    began = time.process_time()
    assert html.blocks("<div>" * 100_000 + "deep" + "</p>" * 100_000)[0].text == "deep"
    assert time.process_time() - began < 5
    assert [b.text for b in html.blocks('<p>a</p><p title=">">b</p>c<p \'x>y</p>d<!-- > e')] == ["a", "b", "c", "y", "d"]
