"""What moves in TF-IDF fits and in the sparse grid."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tastemap.operators import tfidf
from tastemap.operators import similarity as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXTS = ([(1, "red green blue"), (1, "red red"), (2, "blue blue sky"), (3, None), (4, "the of"), (None, "red lost")]
         + [(5, f"red word{i % 7}") for i in range(20)] + [(10 + i, f"sky word{i} green") for i in range(8)])


def by_hand(texts):
    docs = {}
    for key, text in texts:
        docs.setdefault(key, Counter()).update(w for w in (text or "").split() if w not in ("the", "of"))
    df = Counter(w for words in docs.values() for w in words)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for key, words in docs.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in words.items()))
        if key is not None:  # a document without a key counts, but has no weights
            out |= {(key, w): n * idf[w] / norm for w, n in words.items()}
    return out, idf


@pytest.mark.parametrize("hot_rows,terms", [(1024, 200_000), (1024, 3), (1024, 0), (4, 3), (0, 200_000)])
def test_fit_moves_texts_by_key(spark, monkeypatch, hot_rows, terms):
    monkeypatch.setattr(tfidf, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", terms)
    model = tfidf.fit(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    weights, idf = by_hand(TEXTS)
    assert {r.term: r.idf for r in model.idf.collect()} == pytest.approx(idf)
    rows = model.weights.collect()
    assert len(rows) == len(weights) and {(r.doc_id, r.term): r.weight for r in rows} == pytest.approx(weights)
    if hot_rows == 1024:  # neither postings nor norms move by key once the texts have
        moved = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?(?:, (\w+)#)?", plan(model.weights).split("Initial Plan")[0])
        assert ("doc_id", "") in moved and ("doc_id", "term") not in moved and ("id", "") not in moved, moved


def test_grid_copies_do_not_follow_the_rows(spark):
    rows = spark.range(60_000).selectExpr("id", "CAST(id % 3 AS STRING) AS key", "1D AS w")
    res = S.cosine_top_n(rows, rows, 2, exclude_self=True, method="grid")
    chunks = [int(n) for n in re.findall(r"pmod\(xxhash64\(\w+#\w+, 42\), (\d+)\)", plan(res))]
    assert chunks and max(chunks) <= 2 * spark.sparkContext.defaultParallelism, chunks


def test_right_entries_of_unknown_keys_are_not_written(spark, monkeypatch):
    written = []
    checkpoint = type(spark.range(1)).checkpoint

    def counted(df, *args, **kwargs):
        out = checkpoint(df, *args, **kwargs)
        written.append(out.count())
        return out

    left = spark.createDataFrame([(1, "a", 1.0)], "id long, key string, w double")
    right = spark.range(500).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'a' ELSE 'b' END AS key", "0.5D AS w")
    monkeypatch.setattr(type(left), "checkpoint", counted)
    res = S.cosine_top_n(left, right, 9, method="grid")
    assert max(written) == 5
    assert [(r.rid, r.score) for r in res.orderBy("rank").collect()] == [(100 * i, 0.5) for i in range(5)]


def test_null_keys_are_shared_with_none(spark):
    rows = spark.createDataFrame([(1, None, 0.6), (1, "a", 0.8), (2, None, 0.8), (2, "a", 0.6), (3, None, 1.0)],
                                 "id long, key string, w double")
    for method in ("grid", "join"):
        res = S.cosine_top_n(rows, rows, 5, exclude_self=True, method=method)
        assert {(r.lid, r.rid, r.score) for r in res.collect()} == {(1, 2, 0.48), (2, 1, 0.48)}
