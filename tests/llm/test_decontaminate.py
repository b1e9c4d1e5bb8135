"""Contamination against a plain word-by-word scan."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import Row

from tastemap.llm.decontaminate import decontaminate, drop_contaminated, op1_decontaminate

SF = "/root/testdata/sf0.01"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(text, items, window=13):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        k = min(window, len(v))
        windows = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)


def values(r):
    return r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated


def made(seed=3):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "É", "é", "x1", "Z"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 18)))) for i in range(30)]
    docs = []
    for i in range(80):
        parts = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, len(parts))
            parts[at:at] = [f"[{x.upper()}]," for x in draw.choice(items)[1].split()]
        docs.append((i, "\n".join(parts)))
    return docs, items


def test_made_texts_in_one_and_many_blocks(spark):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (900, None), (None, "a b"), items[0]], "item_id long, text string")
    for block_bytes in (1 << 20, 100):
        for r in decontaminate(d, b, block_bytes=block_bytes).collect():
            assert values(r) == plain(docs[r.doc_id][1], items), docs[r.doc_id]
            for s in r.spans:  # whole words of the original text
                assert words(docs[r.doc_id][1][s.start:s.end])
            assert sum(len(words(docs[r.doc_id][1][s.start:s.end])) for s in r.spans) == r.n_hit


def test_whole_table(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: values(r) for r in op1_decontaminate(spark, SF).collect()}
    assert any(v[4] for v in got.values()) and not all(v[4] for v in got.values())
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    some = [r for r in rows if got[r.doc_id][1]] + rows[:40]
    assert {r.doc_id: got[r.doc_id] for r in some} == {r.doc_id: plain(r.text, items) for r in some}


def test_edges_of_the_input(spark):
    rows = [Row(doc_id=None, text="one two", n_hit=1, spans="x"), Row(doc_id=1, text=None, n_hit=1, spans="x"),
            Row(doc_id=1, text="", n_hit=1, spans="x"), Row(doc_id=2, text="--", n_hit=1, spans="x"),
            Row(doc_id=3, text="Two", n_hit=1, spans="x"), Row(doc_id=3, text="Two", n_hit=1, spans="x"),
            Row(doc_id=4, text="w " * 300000 + "two", n_hit=1, spans="x")]
    docs = spark.createDataFrame(rows)
    items = spark.createDataFrame([Row(item_id=7, text="TWO", extra=1)])
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, items).collect())
    assert got == [(-1, 2, 1, True), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (3, 1, 1, True),
                   (3, 1, 1, True), (4, 300001, 1, False)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 4]
    assert decontaminate(docs, items.filter("false")).filter("contaminated").count() == 0
    assert decontaminate(docs.filter("false"), items).count() == 0
