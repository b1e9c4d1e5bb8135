"""Block naming against a dictionary of whole texts."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import Row

from tastemap.llm.exact_dedup import drop_exact_copies, exact_groups


def plain(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    out = {}
    for text, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            out[d] = (keep, len(members), d == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def check(rows, docs):
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == plain(docs)


def test_many_levels_and_shared_blocks(spark):
    draw = random.Random(1)
    pool = ["".join(draw.choice("abé😀") for _ in range(draw.randint(1, 40))) for _ in range(20)]
    docs = []
    for i in range(300):  # few blocks in many orders, with spaces that do not count
        docs.append((i, draw.choice(["", " ", "\n\t"]).join(draw.choice(pool[:4]) for _ in range(draw.randint(0, 7)))))
    docs += [(1000 + i, "x" * n) for i, n in enumerate([3, 4, 5, 7, 8, 9, 15, 16, 17, 4, 8, 16])]
    docs += [(2000 + i, "hot" * 10 + " " * (i % 7)) for i in range(200)]
    docs += [(3000 + i, "hot" * 10 + "tail") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for block_chars in (1, 4, 1000):
        check(exact_groups(df.checkpoint(), block_chars=block_chars).collect(), docs)


def test_edges_of_the_input(spark):
    rows = [Row(doc_id=None, text="a b", n=1, name="x"), Row(doc_id=2, text="ab", n=1, name="x"),
            Row(doc_id=3, text=None, n=1, name="x"), Row(doc_id=4, text="\v", n=1, name="x"),
            Row(doc_id=5, text="z", n=1, name="x"), Row(doc_id=5, text="z", n=1, name="x"),
            Row(doc_id=6, text="q" * 100000, n=1, name="x"), Row(doc_id=7, text="q" * 50000 + " " + "q" * 50000, n=1, name="x")]
    docs = spark.createDataFrame(rows)
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_groups(docs).collect())
    assert got == [(-1, -1, 2, True), (2, -1, 2, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, False),
                   (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True)]
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 4, 5, 7]
    assert exact_groups(docs.filter("false")).count() == 0


def test_a_block_in_a_third_of_the_rows_gets_salts_in_proportion(spark, monkeypatch):
    from tastemap.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 10)
    docs = [(i, ("hot" * 10 + " " * (i % 5)) if i % 3 == 0 else f"text {i % 170}") for i in range(600)]
    check(exact_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block_chars=16).collect(), docs)
