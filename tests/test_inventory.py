"""Smaller operators of the inventory and a skewed-input check of the neighbour engine."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemap.operators import catalogue as cat_ops
from tastemap.operators import factors, lookup, neighbours, profile


def test_point_lookup_and_fetch_by_position(spark):
    df = spark.createDataFrame([(10, 7, "a"), (11, 7, "b"), (12, 8, "c")], "row_pos long, product_id long, t string")
    req = spark.createDataFrame([(7,), (9,)], "product_id long")
    first = {r["product_id"]: r["row_pos"] for r in cat_ops.point_lookup(df, "product_id", req).collect()}
    assert first == {7: 10}
    pos = spark.createDataFrame([(12, 1), (10, 2)], "row_pos long, rank int")
    got = [r["t"] for r in cat_ops.fetch_by_position(df, pos).orderBy("rank").collect()]
    assert got == ["c", "a"]


def test_encode_decode_and_empty_results(spark):
    mapping = lookup.id_index(spark.createDataFrame([("USER_1",), ("USER_0",)], "id string"))
    df = spark.createDataFrame([("USER_1", 5.0), ("USER_9", 1.0)], "user string, r double")
    enc = lookup.encode(df, "user", mapping, "u_idx")
    assert [(r["user"], r["u_idx"]) for r in enc.collect()] == [("USER_1", 1)]
    dec = lookup.decode(enc.select("u_idx", "r"), "u_idx", mapping, "user")
    assert [r["user"] for r in dec.collect()] == ["USER_1"]
    req = spark.createDataFrame([(1,), (2,)], "request_key long")
    res = spark.createDataFrame([(2, 5)], "request_key long, product_id long")
    assert [r[0] for r in lookup.requests_without_results(req, res, "request_key").collect()] == [1]


def test_shape(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "a long, b string")
    row = profile.shape(df).first()
    assert (row["row_count"], row["column_count"]) == (2, 2)


def test_predict_and_factor_round_trip(spark, tmp_dir):
    uf = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    itf = spark.createDataFrame([(5, [3.0, -1.0]), (6, [0.5, 0.5])], "id long, vec array<double>")
    f = factors.Factors(uf, itf, np.array([1.0, 1.0]))
    path = os.path.join(tmp_dir, "model")
    factors.save(f, path)
    g = factors.load(spark, path)
    pairs = spark.createDataFrame([(1, 5), (1, 6)], "user_id long, product_id long")
    got = {r["product_id"]: r["predicted_rating"] for r in factors.predict(g, pairs).collect()}
    assert got == {5: pytest.approx(1.0), 6: pytest.approx(1.5)}


def test_neighbours_exact_under_skew(spark):
    """One product rated by every user and one user who rated a third of all
    rows: the engine must pick the grid (the key join would emit almost all
    pairs) and still return the exact brute-force ranking."""
    rng = np.random.default_rng(9)
    rows = []
    for u in range(60):
        rows.append((u, 0, float(rng.integers(1, 5))))           # hot product 0
        for p in rng.choice(np.arange(1, 40), size=2, replace=False):
            rows.append((u, int(p), float(rng.integers(1, 5))))
    rows += [(999, int(p), 1.0) for p in range(1, 40)] * 2       # power user (duplicates averaged)
    inter = spark.createDataFrame(rows, "user_id long, product_id long, rating double")
    m = neighbours.rating_matrix(inter)
    got = {}
    for r in neighbours.similar_users(m, n=3).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["sim"], r["neighbour_id"]))
    mat = {}
    for r in m.collect():
        mat.setdefault(r["user_id"], {})[r["product_id"]] = r["rating"]
    norm = {u: np.sqrt(sum(v * v for v in d.values())) for u, d in mat.items()}
    for u, du in mat.items():
        cands = []
        for v, dv in mat.items():
            if u == v or not (set(du) & set(dv)):
                continue
            s = sum(du[k] * dv[k] for k in set(du) & set(dv)) / (norm[u] * norm[v])
            cands.append((round(s, 6), v))
        cands.sort(key=lambda t: (-t[0], t[1]))
        want = [(i + 1, s, v) for i, (s, v) in enumerate(cands[:3])]
        assert sorted(got[u]) == want


def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(300, 7.0), rng.normal(size=600)])      # one value is a third of the column
    y = rng.integers(0, 50, size=900).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["column_name"]: (r["q25"], r["q50"], r["q75"]) for r in profile.quantiles(df, ["x", "y"]).collect()}
    for name, arr in (("x", x), ("y", y)):
        want = tuple(round(float(np.percentile(arr, q)), 6) for q in (25, 50, 75))
        assert got[name] == pytest.approx(want, abs=1e-6)


def test_large_sample_path_equals_take_ordered(spark, monkeypatch):
    from tastemap.operators import sampling

    df = spark.range(0, 3000).withColumnRenamed("id", "row_pos")
    small = sorted(r[0] for r in sampling.sample_exact(df, 700, "row_pos").collect())
    monkeypatch.setattr(sampling, "TAKE_ORDERED_MAX", 10)
    large = sorted(r[0] for r in sampling.sample_exact(df, 700, "row_pos").collect())
    assert small == large and len(large) == 700


def test_cluster_conf_sizes_partitions():
    from tastemap.session import cluster_conf

    c = cluster_conf(100 * 10**12, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert cluster_conf(10**6, 64)["spark.sql.shuffle.partitions"] == "128"     # at least two waves
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_quantiles_refine_over_few_bins_and_odd_values(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(200, -1.5), rng.exponential(size=500), rng.normal(size=50) * 1e-300, [1e300, -1e300]])
    y = np.concatenate([rng.integers(0, 3, size=750).astype(float), [np.inf, -np.inf]])
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)], "x double, y double, z double")
    for bins in (4, 4096):
        got = {r["column_name"]: (r["q25"], r["q50"], r["q75"]) for r in profile.quantiles(df, ["x", "y", "z"], bins=bins).collect()}
        assert set(got) == {"x", "y"}
        for name, arr in (("x", x), ("y", y)):
            assert got[name] == pytest.approx(tuple(round(float(np.percentile(arr, q)), 6) for q in (25, 50, 75)), abs=1e-6)
