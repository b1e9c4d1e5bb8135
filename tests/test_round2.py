"""Converged SVD, one behaviour of both similarity plans, learned scorer, fills at scale, sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemap.functions.ranking import half_up, half_up_array
from tastemap.operators import als, catalogue, cleaning, content, factors, lookup, neighbours
from tastemap.operators.similarity import cosine_top_n, dense_top_n
from tastemap.sources import files
from tastemap.sources import tables as T

SF = "/root/testdata/sf0.001"


def dense_of(m):
    rows = m.collect()
    users, items = sorted({r.user_id for r in rows}), sorted({r.product_id for r in rows})
    a = np.zeros((len(users), len(items)))
    for r in rows:
        a[users.index(r.user_id), items.index(r.product_id)] = r.rating
    return users, items, a


def top_lists(scores, n=10):
    return np.argsort(-half_up_array(scores), axis=1, kind="stable")[:, :n]


@pytest.mark.parametrize("k", [5, 20])
def test_svd_lists_equal_the_exact_ones_for_any_seed(spark, k):
    m = neighbours.rating_matrix(T.interactions(spark, SF)).checkpoint()
    users, items, a = dense_of(m)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    want = (u[:, :k] * s[:k]) @ vt[:k]
    for seed in (1, 2):
        f = factors.truncated_svd(m, k=k, seed=seed)
        assert np.allclose(f.singular_values, s[:k], rtol=1e-9)
        us = {r.id: r.vec for r in f.user_factors.collect()}
        v = {r.id: r.vec for r in f.item_factors.collect()}
        got = np.array([us[x] for x in users]) @ np.array([v[x] for x in items]).T
        assert np.abs(got - want).max() < 1e-6
        assert (top_lists(got) == top_lists(want)).mean() > 0.999  # but for scores that round apart


def test_svd_of_low_rank_string_ids_and_empty(spark):
    a = np.outer([1.0, 2.0, 0.0, 3.0], [2.0, 0.0, 1.0])
    rows = [(f"USER_{i}", f"p{j}", float(a[i, j])) for i in range(4) for j in range(3)]
    m = spark.createDataFrame(rows, "user_id string, product_id string, rating double")
    f = factors.truncated_svd(m, k=5)
    assert len(f.singular_values) == 1 and np.isclose(f.singular_values[0], np.linalg.norm(a))
    recs = factors.recommend(f, m, 3, exclude_rated=True).collect()
    assert {(r.user_id, r.product_id) for r in recs} == {
        (f"USER_{i}", f"p{j}") for i in range(4) for j in range(3) if a[i, j] == 0}
    none = factors.truncated_svd(m.withColumn("rating", F.lit(0.0)), k=2)
    assert none.singular_values.size == 0


def test_svd_that_cannot_converge_is_an_error(spark):
    rng = np.random.default_rng(1)
    rows = [(i, j, float(rng.normal())) for i in range(40) for j in range(40)]
    m = spark.createDataFrame(rows, "user_id long, product_id long, rating double")
    with pytest.raises(RuntimeError, match="not converged"):
        factors.truncated_svd(m, k=3, width=4, max_rounds=1)


def test_saved_model_keeps_its_singular_values(spark, tmp_dir):
    m = neighbours.rating_matrix(T.interactions(spark, SF)).limit(300).checkpoint()
    f = factors.truncated_svd(m, k=3)
    factors.save(f, f"{tmp_dir}/model")
    again = factors.load(spark, f"{tmp_dir}/model")
    assert np.array_equal(again.singular_values, f.singular_values)
    assert sorted(map(tuple, (r.vec for r in again.item_factors.collect()))) == sorted(
        map(tuple, (r.vec for r in f.item_factors.collect())))


def test_one_rounding_everywhere(spark):
    values = [0.0078125, -0.0078125, 0.0, -1e-9, 1 / 3, 2.5e-7, 123456.0000005]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(half_up("v").alias("x")).collect()]
    assert got == list(half_up_array(np.array(values)))
    assert got[0] == 0.007813 and str(got[3]) == "0.0"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_join_and_grid_agree_on_ids_and_rounding(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(i + (1 << 60), f"k{int(k)}", float(2.0 ** -int(rng.integers(0, 7)))) for i in range(40)
            for k in rng.choice(12, size=4, replace=False)]  # dyadic scores: sums are exact
    df = spark.createDataFrame(rows, "id long, key string, w double").withColumn("id", F.col("id").cast(kind))
    ban = df.select(F.col("id").alias("lid")).distinct().withColumn("rid", F.col("lid"))
    out = [sorted(map(tuple, cosine_top_n(df, df, 6, exclude_pairs=ban, method=m, left_chunk=7, right_block=9)
                      .select("lid", "rid", "score", "rank").collect())) for m in ("join", "grid")]
    assert out[0] == out[1] and len(out[0]) > 100
    assert all(lid != rid for lid, rid, *_ in out[0])


def test_a_row_with_a_third_of_the_entries(spark):
    rows = [(0, k, 1.0) for k in range(600)] + [(1 + i, (7 * i + j) % 600, 1.0) for i in range(300) for j in range(4)]
    df = spark.createDataFrame(rows, "id long, key long, w double")
    out = [sorted(map(tuple, cosine_top_n(df, df, 3, exclude_self=True, method=m, left_chunk=64, right_block=64)
                      .select("lid", "rid", "score", "rank").collect())) for m in ("join", "grid")]
    assert out[0] == out[1]


def test_dense_plan_takes_string_ids(spark):
    rows = [(f"v{i}", [float(i), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    ban = spark.createDataFrame([("v0", "v8")], "lid string, rid string")
    got = {r.lid: r.rid for r in dense_top_n(df, df, 1, exclude_self=True, exclude_pairs=ban).collect()}
    assert got["v8"] == "v7" and got["v1"] == "v8" and got["v0"] == "v1"


def test_pair_sums_happen_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, i % 5, 1.0) for i in range(50)], "id long, key long, w double")
    plan = cosine_top_n(df, df, 2, exclude_self=True, method="join")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" not in plan and "partial_sum" in plan


def test_als_recovers_a_planted_matrix(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(1, 2, (30, 2)) @ rng.uniform(1, 2, (2, 20))
    rows = [(f"u{i:02d}", f"p{j:02d}", float(a[i, j])) for i in range(30) for j in range(20) if (i + j) % 4]
    m = spark.createDataFrame(rows, "user_id string, product_id string, rating double")
    f = als.fit(m, rank=2, max_iter=15, reg=0.001)
    us = {r.id: np.array(r.vec) for r in f.user_factors.collect()}
    v = {r.id: np.array(r.vec) for r in f.item_factors.collect()}
    recs = als.recommend(f, n=4).collect()
    for r in recs:
        assert abs(r.predicted_rating - us[r.user_id] @ v[r.product_id]) < 1e-5
    for u in us:
        assert sorted(r["rank"] for r in recs if r.user_id == u) == [1, 2, 3, 4]
    errors = [abs(us[f"u{i:02d}"] @ v[f"p{j:02d}"] - a[i, j]) / a[i, j] for i in range(30) for j in range(20)]
    assert np.mean(errors) < 0.02  # left-out pairs included


def test_repeated_catalogue_rows_do_not_count_twice(spark):
    rows = [(1, "red shoe", 0), (2, "blue shoe", 1), (1, "green hat", 2)]
    cat = spark.createDataFrame(rows, "product_id long, tags string, row_pos long")
    once = content.fit_catalogue(cat.filter("row_pos < 2")).weights.collect()
    twice = content.fit_catalogue(cat).weights.collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, twice))
    log = spark.createDataFrame([(1, "shoe"), (2, "hat"), (3, ""), (4, None)], "request_key long, query string")
    assert sorted(r.request_key for r in content.without_results(content.fit_catalogue(cat), log).collect()) == [2, 3, 4]


def test_details_of_unknown_products_stay_null(spark):
    cat = T.catalogue(spark, SF)
    ranked = spark.createDataFrame([(1, 1), (2, -5)], "rank int, product_id long")
    got = {r["rank"]: r for r in catalogue.with_details(ranked, cat).collect()}
    assert got[1].image_url == "img/1" and got[2].name is None
    assert lookup.missing_ids(ranked, cat).collect()[0].product_id == -5


@pytest.mark.parametrize("bucket", [3, 4096])
def test_fills_of_a_hot_key_and_null_keys(spark, bucket):
    import pandas as pd

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"row_pos": np.arange(300), "key": rng.choice(["hot", "hot", "a", None], 300),
                        "x": rng.choice([1.0, np.nan, np.nan, np.nan], 300) * np.arange(300)})
    pdf.loc[pdf.row_pos.between(40, 120), "x"] = np.nan  # long gaps cross buckets and their groups
    df = spark.createDataFrame([(int(r.row_pos), r.key, None if np.isnan(r.x) else float(r.x))
                                for r in pdf.itertuples()], "row_pos long, key string, x double")
    got = {r.row_pos: r.x for r in cleaning.group_ffill_bfill(df, "key", ["x"], bucket=bucket).collect()}
    want = pdf.groupby("key", dropna=True)["x"].transform(lambda g: g.ffill().bfill())
    assert got == {i: None if np.isnan(v) else v for i, v in want.reindex(range(300)).items()}


def test_delimited_files_split_by_default_and_span_lines_on_request(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as out:
        out.write('id,text\n1,"two\nlines"\n2,"a ""b"""\n')
    rows = files.read_csv(spark, f"{tmp_dir}/a.csv", "id int, text string", multi_line=True).orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [(1, "two\nlines"), (2, 'a "b"')]
    assert files.read_csv(spark, f"{tmp_dir}/a.csv", "id int, text string").count() == 3


def test_wide_matrix_sink(spark, tmp_dir):
    ev = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 5.0)], "user_id long, item string, rating double")
    files.write_wide_matrix(neighbours.wide_matrix(ev, "item", ["a", "b"]), f"{tmp_dir}/w")
    rows = files.read_csv(spark, f"{tmp_dir}/w", "user_id long, a double, b double").orderBy("user_id").collect()
    assert [tuple(r) for r in rows] == [(1, 3.0, 0.0), (2, 0.0, 5.0)]
