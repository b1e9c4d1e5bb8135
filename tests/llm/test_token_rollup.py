"""Rollups against a count from scratch."""

from __future__ import annotations

import base64
import tempfile

import pytest
import tiktoken
from pyspark.sql import Row

from tastemap.llm.token_rollup import (RANKS_FILE, SPLIT, TokenRollup, bpe_counts, deleted, inserted,
                                       op4_token_rollup, revised, word_counts)

SF = "/root/testdata/sf0.001"


def encoding():
    with open(RANKS_FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_a_recount(spark):
    import re

    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = min(labels.get(r.doc_id, 1), r.quality)
    enc, want = encoding(), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r.text or ""
        if labels.get(r.doc_id) == 0:
            continue
        if labels.get(r.doc_id):
            text = re.sub(r"[!#$%&*]+", "", text)
        for name, n in (("byte-bpe-50k-1", len(enc.encode_ordinary(text))),
                        ("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text)))):
            docs, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = docs + 1, tokens + n
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in op4_token_rollup(spark, SF).collect()}
    assert got == want


def counts(spark, *rows):
    return spark.createDataFrame([(s, g, "t", n, "clash") for s, g, n in rows],
                                 "source string, lang string, tokenizer string, tokens long, docs string")


def totals(rollup):
    return {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_deltas_and_replayed_batches(spark):
    rollup = TokenRollup(spark, tempfile.mkdtemp(prefix="tm-rollup-") + "/r")
    assert totals(rollup) == {} and rollup.committed() == []
    first = counts(spark, ("a", "en", 5), ("a", "en", 7), (None, None, 2), ("b", "en", 0))
    assert rollup.commit("1", inserted(first))
    assert not rollup.commit("1", inserted(first))
    assert totals(rollup) == {("a", "en"): (2, 12), (None, None): (1, 2), ("b", "en"): (1, 0)}
    assert rollup.commit("2", revised(counts(spark, ("a", "en", 7)), counts(spark, ("a", "fr", 9))))
    assert rollup.commit("3", deleted(counts(spark, (None, None, 2))))
    assert rollup.commit("4", inserted(first.filter("false")))
    assert totals(rollup) == {("a", "en"): (1, 5), ("a", "fr"): (1, 9), ("b", "en"): (1, 0)}
    assert rollup.committed() == ["1", "2", "3", "4"]
    for bad in ("", "a/b"):
        with pytest.raises(ValueError):
            rollup.commit(bad, inserted(first))


def test_a_batch_that_broke_off_does_not_count_and_is_written_anew(spark):
    folder = tempfile.mkdtemp(prefix="tm-rollup-")
    rollup = TokenRollup(spark, folder)
    whole = counts(spark, ("a", "en", 5))
    inserted(whole).write.parquet(f"{folder}/batch-1")
    files = rollup._files()
    files.delete(rollup._file("batch-1", "_SUCCESS"), False)
    assert totals(rollup) == {} and rollup.committed() == []
    assert rollup.commit("1", inserted(counts(spark, ("a", "en", 6))))
    assert totals(rollup) == {("a", "en"): (1, 6)}


def test_counting_edges(spark):
    enc = encoding()
    texts = [None, "", " \n", "<|endoftext|> it's  é😀", "a" * 100000]
    rows = spark.createDataFrame([Row(k=i, text=t, tokens="clash") for i, t in enumerate(texts)]).select("k", "text")
    got = {r.k: r.tokens for r in bpe_counts(rows, "text", version="v").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert {r.k: r.tokens for r in word_counts(rows, "text").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 1}
    assert bpe_counts(rows.filter("false"), "text", version="v").count() == 0
