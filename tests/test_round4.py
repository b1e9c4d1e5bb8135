"""What moves in rankings: key joins, neighbours' ratings, dense cells, draws."""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tastemap.functions.ranking import half_up_array
from tastemap.operators import neighbours, sampling
from tastemap.operators import similarity as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entries(seed, rows=60, keys=25):
    draw = random.Random(seed)
    return [(i, k, draw.random()) for i in range(rows) for k in draw.sample(range(keys), draw.randint(1, 6))]


def by_pairs(rows, n):
    vecs = {}
    for i, k, w in rows:
        vecs.setdefault(i, {})[k] = w
    out = set()
    for i, a in vecs.items():
        scores = [(-float(half_up_array(np.float64(sum(w * b[k] for k, w in a.items() if k in b)))), j)
                  for j, b in vecs.items() if j != i and a.keys() & b.keys()]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(scores)[:n])}
    return out


def test_key_join_moves_lists_once(spark, monkeypatch):
    rows = entries(3)
    df = spark.createDataFrame(rows, "id long, key long, w double")
    for heavy, postings in ((S.HEAVY_PRODUCTS, S.POSTINGS), (20, 3), (0, 1)):
        monkeypatch.setattr(S, "HEAVY_PRODUCTS", heavy)
        monkeypatch.setattr(S, "POSTINGS", postings)
        res = S.cosine_top_n(df, df, 4, exclude_self=True, method="join")
        assert {(r.lid, r.rid, r["rank"]) for r in res.collect()} == by_pairs(rows, 4)
        if heavy > 20:  # pairs are not shuffled
            assert not re.search(r"hashpartitioning\(lid#\w+, rid#", plan(res)), plan(res)


def test_ratings_of_neighbours_move_once(spark):
    m = spark.createDataFrame([(u, p, float(1 + (u * p) % 5)) for u in range(12) for p in range(u % 3, 20, 3)],
                              "user_id long, product_id long, rating double")
    res = neighbours.user_based(m, neighbours.similar_users(m, n=3, method="join"), n=5)
    assert not re.search(r"Exchange hashpartitioning\(user_id#\w+, product_id#", plan(res).split("SortMergeJoin")[0]), plan(res)


def test_dense_kernel_over_tiles(monkeypatch):
    monkeypatch.setattr(S, "LEFT_TILE", 7)
    monkeypatch.setattr(S, "RIGHT_BLOCK", 5)
    draw = np.random.default_rng(1)
    for width, ties in ((3, False), (2, True)):
        vecs = draw.integers(-2, 3, (40, width)).astype(float) if ties else draw.standard_normal((40, width))
        ids = draw.permutation(100)[:40]
        banned = [sorted(draw.choice(ids, draw.integers(0, 30), replace=False)) for _ in ids]
        left = pd.DataFrame({"lid": ids, "vec": list(vecs), "excl": banned})
        for n in (1, 4, 60):
            got = S._dense_kernel(n, True)(left, pd.DataFrame({"rid": ids, "vec": list(vecs)}))
            scores = half_up_array(vecs @ vecs.T)
            want = []
            for i, u in enumerate(ids):
                ranked = sorted((-scores[i, j], v) for j, v in enumerate(ids) if v != u and v not in banned[i])[:n]
                want += [(u, v, -s) for s, v in ranked]
            assert [tuple(r) for r in got.itertuples(index=False)] == want


def test_dense_copies_follow_the_cores(spark):
    left = spark.range(200_000).select("id", F.array(F.rand(1), F.rand(2)).alias("vec"))
    right = left.filter("id < 50")
    chunks = re.findall(r"pmod\(xxhash64\(\w+#\w+, 42\), (\d+)\)", plan(S.dense_top_n(left, right, 3)))
    assert chunks and max(map(int, chunks)) <= 2 * spark.sparkContext.defaultParallelism


def test_draws_join_their_items_by_shuffle(spark):
    res = sampling.distinct_draws(spark.range(30).withColumnRenamed("id", "u"), "u", spark.range(40), "id", 5)
    assert re.search(r"SortMergeJoin \[_pos#", plan(res)), plan(res)
    assert res.groupBy("u").count().filter("count = 5").count() == 30
