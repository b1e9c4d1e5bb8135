"""Top-n dot/cosine engine against brute force, on both the join and grid paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemap.operators.similarity import cosine_top_n, l2_normalise


def brute(left, right, n, exclude_self, positive_only, excluded=frozenset()):
    out = {}
    for lid, lv in left.items():
        cands = []
        for rid, rv in right.items():
            if exclude_self and lid == rid:
                continue
            if (lid, rid) in excluded:
                continue
            shared = set(lv) & set(rv)
            s = sum(lv[k] * rv[k] for k in shared)
            if positive_only and (not shared or s <= 0):
                continue
            cands.append((round(s, 6), rid))
        cands.sort(key=lambda t: (-t[0], t[1]))
        out[lid] = cands[:n]
    return out


def to_df(spark, vecs):
    rows = [(i, str(k), float(w)) for i, v in vecs.items() for k, w in v.items()]
    return spark.createDataFrame(rows, "id long, key string, w double")


def result(df):
    out = {}
    for r in df.orderBy("lid", "rank").collect():
        out.setdefault(r["lid"], []).append((r["score"], r["rid"]))
    return out


def random_vectors(rng, n_ids, n_keys, per_row, hot_key=None):
    vecs = {}
    for i in range(n_ids):
        keys = rng.choice(n_keys, size=per_row, replace=False)
        v = {int(k): float(rng.integers(1, 4)) for k in keys}
        if hot_key is not None:
            v[hot_key] = 1.0
        norm = np.sqrt(sum(x * x for x in v.values()))
        vecs[i] = {k: x / norm for k, x in v.items()}
    return vecs


@pytest.mark.parametrize("method", ["auto", "join", "grid"])
def test_matches_brute_force(spark, method):
    rng = np.random.default_rng(7)
    vecs = random_vectors(rng, 60, 25, 3, hot_key=99)  # key 99 is in every row
    df = to_df(spark, vecs)
    got = result(cosine_top_n(df, df, 5, exclude_self=True, method=method))
    want = brute(vecs, vecs, 5, True, True)
    assert {k: v for k, v in want.items() if v} == got


def test_twin_and_self_exclusion(spark):
    # users 1 and 2 identical: each is the other's best neighbour, never itself
    vecs = {1: {"a": 0.6, "b": 0.8}, 2: {"a": 0.6, "b": 0.8}, 3: {"a": 1.0}}
    df = to_df(spark, vecs)
    got = result(cosine_top_n(df, df, 1, exclude_self=True, method="grid"))
    assert got[1] == [(1.0, 2)] and got[2] == [(1.0, 1)]


def test_ties_break_by_id(spark):
    vecs = {1: {"a": 1.0}, 5: {"a": 1.0}, 3: {"a": 1.0}, 4: {"a": 1.0}}
    df = to_df(spark, vecs)
    for method in ("grid", "join"):
        got = result(cosine_top_n(df, df, 2, exclude_self=True, method=method))
        assert [rid for _, rid in got[5]] == [1, 3]


def test_dense_and_excluded_pairs(spark):
    rng = np.random.default_rng(3)
    vecs = {i: {d: float(x) for d, x in enumerate(rng.normal(size=8))} for i in range(30)}
    excluded = {(i, (i * 7) % 30) for i in range(30)}
    df = to_df(spark, vecs)
    ex = spark.createDataFrame(sorted(excluded), "lid long, rid long")
    got = result(cosine_top_n(df, df, 4, positive_only=False, exclude_pairs=ex))
    want = brute(vecs, vecs, 4, False, False, excluded)
    assert got == want


def test_l2_normalise_drops_zero_vectors(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "u long, k string, v double")
    out = {(r["id"], r["key"]): r["w"] for r in l2_normalise(df, "u", "k", "v").collect()}
    assert out == {(1, "a"): pytest.approx(0.6), (1, "b"): pytest.approx(0.8)}


def test_grid_with_several_cells(spark):
    rng = np.random.default_rng(11)
    vecs = random_vectors(rng, 50, 6, 2, hot_key=77)
    df = to_df(spark, vecs)
    got = result(cosine_top_n(df, df, 3, exclude_self=True, method="grid", left_chunk=7, right_block=9))
    want = brute(vecs, vecs, 3, True, True)
    assert got == {k: v for k, v in want.items() if v}


def test_dense_top_n_matches_brute_force(spark):
    from tastemap.operators.similarity import dense_top_n

    rng = np.random.default_rng(5)
    mats = {i: rng.normal(size=6) for i in range(40)}
    excluded = {(i, (3 * i + 1) % 40) for i in range(40)} | {(0, j) for j in range(0, 40, 2)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in mats.items()], "id long, vec array<double>")
    ex = spark.createDataFrame(sorted(excluded), "lid long, rid long")
    got = result(dense_top_n(df, df, 5, exclude_self=True, exclude_pairs=ex, left_chunk=9, right_block=13))
    vecs = {i: dict(enumerate(v)) for i, v in mats.items()}
    want = brute(vecs, vecs, 5, True, False, excluded)
    assert got == want


def test_sparse_kernel_long_tail_keys(spark, monkeypatch):
    import tastemap.operators.similarity as S

    monkeypatch.setattr(S, "DENSE_KEYS", 3)          # force most keys through the outer-product loop
    rng = np.random.default_rng(21)
    vecs = random_vectors(rng, 45, 30, 4, hot_key=5)
    df = to_df(spark, vecs)
    ex = spark.createDataFrame([(i, (i + 1) % 45) for i in range(45)], "lid long, rid long")
    got = result(S.cosine_top_n(df, df, 4, exclude_self=True, method="grid", exclude_pairs=ex,
                                left_chunk=10, right_block=16))
    want = brute(vecs, vecs, 4, True, True, {(i, (i + 1) % 45) for i in range(45)})
    assert got == {k: v for k, v in want.items() if v}
