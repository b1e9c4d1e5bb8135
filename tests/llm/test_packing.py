"""Packing against a naive best fit, and its invariants."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Row

from tastemap.llm.packing import op8_best_fit_packing, pack, pack_documents, pack_shard

SF = "/root/testdata/sf0.01"


def naive(rows, capacity):
    """``{(row, piece): bin}`` by trying every open bin."""
    pieces = [(-min(capacity, words - p * capacity), row, p, source, cluster)
              for row, source, cluster, words in rows for p in range(-(-words // capacity))]
    bins, out = [], {}  # (room, order of that room, sources, clusters)
    clock = 0
    for size, row, piece, source, cluster in sorted(pieces, key=lambda x: x[:3]):
        fits = [b for b in bins if b["room"] >= -size and b["room"] > 0 and source not in b["sources"]
                and (cluster is None or cluster not in b["clusters"])]
        best = min(fits, key=lambda b: (b["room"], b["since"])) if fits else None
        if best is None:
            best = {"room": capacity, "sources": set(), "clusters": set(), "id": len(bins), "since": 0}
            bins.append(best)
        clock += 1
        best["room"] += size
        best["since"] = clock
        best["sources"].add(source)
        if cluster is not None:
            best["clusters"].add(cluster)
        out[row, piece] = best["id"]
    return out


def shard(draw, n, sources, clusters, most):
    return [(i, draw.choice(sources), draw.choice(clusters), draw.randint(0, most)) for i in range(n)]


def test_tightest_compatible_bin_is_found():
    draw = random.Random(4)
    for sources, clusters, most in ((["a", "b", "c", None], [None], 30), ([f"s{i}" for i in range(90)], [None, 1, 2], 120),
                                    (["a"] * 5 + [f"s{i}" for i in range(9)], [f"c{i}" for i in range(150)], 60)):
        rows = shard(draw, 400, sources, clusters, most)
        frame = pd.DataFrame(rows, columns=["_tm_row", "_tm_source", "_tm_cluster", "_tm_words"])
        got = pack_shard(frame, 50)
        placed = zip(got["_tm_row"], got["piece"], got["bin"], strict=True)
        assert {(row, piece): b for row, piece, b in placed} == naive(rows, 50)


def invariants(rows, docs, capacity):
    """``docs``: id to (source, cluster, words)."""
    words, bins = dict.fromkeys(docs, 0), {}
    for r in rows:
        words[r.doc_id] += r.n_words
        if r.bin_id is None:
            assert docs[r.doc_id][2] == 0
            continue
        bins.setdefault(r.bin_id, []).append(r)
    assert words == {d: v[2] for d, v in docs.items()}
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= capacity
        assert len({docs[r.doc_id][0] for r in held}) == len(held)
        clusters = [docs[r.doc_id][1] for r in held if docs[r.doc_id][1] is not None]
        assert len(set(clusters)) == len(clusters)
    return bins


def test_whole_table(spark):
    docs = {r.doc_id: (r.source, "".join(r.text.split()), len(r.text.split()))
            for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins = invariants(op8_best_fit_packing(spark, SF).collect(), docs, 2048)
    assert sum(v[2] for v in docs.values()) > 0.6 * 2048 * len(bins)


def test_several_shards(spark):
    draw = random.Random(8)
    rows = [(i, draw.choice(["hot", "hot", "a", "b", None]), draw.choice([None, 1, 1, 2]), draw.randint(0, 130))
            for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, cluster long, words long").checkpoint()
    got = pack(df, capacity=50, shard_rows=60).collect()
    invariants(got, {r[0]: r[1:] for r in rows}, 50)
    assert len({r.bin_id >> 32 for r in got if r.bin_id is not None}) > 5


def test_edges_of_the_input(spark):
    rows = [Row(doc_id=None, source=None, text="a b", bin="x"), Row(doc_id=1, source="s", text=None, bin="x"),
            Row(doc_id=2, source="s", text="", bin="x"), Row(doc_id=3, source="s", text="w " * 5000, bin="x"),
            Row(doc_id=3, source="s", text="w " * 5000, bin="x")]
    docs = spark.createDataFrame(rows)
    got = pack_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.piece, r.n_words, r.bin_id is None) for r in got) == [
        (-1, 0, 2, False), (1, 0, 0, True), (2, 0, 0, True), (3, 0, 2048, False), (3, 0, 2048, False),
        (3, 1, 2048, False), (3, 1, 2048, False), (3, 2, 904, False), (3, 2, 904, False)]
    assert len({r.bin_id for r in got if r.doc_id == 3}) == 6
    assert pack_documents(docs.filter("false")).count() == 0
