"""Bounded SVD basis, pruned dense search, threshold samples, wide export, saved models, damaged files, sketches, hubs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemap.operators import content, factors, neighbours, popularity, profile, sampling, tfidf
from tastemap.operators.similarity import dense_top_n
from tastemap.sources import files, models
from tastemap.sources import tables as T

SF = "/root/testdata/sf0.001"


def ratings_of(spark, a):
    rows = [(i, j, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame([(int(i), int(j), r) for i, j, r in rows], "user_id long, product_id long, rating double")


def test_svd_basis_never_exceeds_its_width(spark, monkeypatch):
    """A noisy matrix far larger than the block: several filters, locked pairs, and no more columns than asked for."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(90, 120)) * (rng.random((90, 120)) < 0.3)
    a += 3 * np.outer(rng.random(90), rng.random(120)) * (a != 0)
    widths, inner = [], factors._inner

    def watched(blocks, columns, *rest):
        widths.append(sum(w for c, w in columns.items() if c in ("x", "l")))
        return inner(blocks, columns, *rest)

    monkeypatch.setattr(factors, "_inner", watched)
    f = factors.truncated_svd(ratings_of(spark, a), k=6, width=20)
    u, s, vt = np.linalg.svd(a)
    assert max(widths) <= 20
    assert np.allclose(f.singular_values, s[:6], rtol=1e-9)
    us = {r.id: r.vec for r in f.user_factors.collect()}
    v = {r.id: r.vec for r in f.item_factors.collect()}
    got = np.array([us[i] for i in sorted(us)]) @ np.array([v[j] for j in sorted(v)]).T
    assert np.abs(got - (u[:, :6] * s[:6]) @ vt[:6]).max() < 1e-6


def test_filter_degrees_follow_the_bounds():
    values = np.array([10.0, 5.0, 4.0, 1.0])
    assert factors._degree(values, np.zeros(0), 3, 1.0, 1e6) <= factors.MAX_DEGREE
    wild = factors._degree(np.array([1e6, 1.1, 1.05]), np.zeros(0), 2, 1.0, 1e6)
    assert wild == 1  # the largest direction would drown the others
    assert factors._degree(np.array([1.1, 1.05]), np.array([1e6]), 2, 1.0, 1e6) <= 3


def test_dense_search_skips_blocks_on_skewed_norms_and_is_exact(spark):
    rng = np.random.default_rng(8)
    right = rng.normal(size=(1500, 6)) * (rng.pareto(1.0, size=(1500, 1)) + 0.05)
    right[100:400] = right[100] / np.linalg.norm(right[100])  # many equal norms, and ties
    left = rng.normal(size=(60, 6))
    excluded = {(i, int(np.argmax(left[i] @ right.T))) for i in range(0, 60, 2)}
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<double>")
    cells = []
    got = dense_top_n(frame(left), frame(right), 5, right_block=40, left_chunk=16, cells=cells, exclude_pairs=spark.createDataFrame(
        sorted(excluded), "lid long, rid long"))
    want = {}
    for i in range(60):
        scores = [(-round(float(left[i] @ right[j]), 6), j) for j in range(1500) if (i, j) not in excluded]
        want[i] = [j for _, j in sorted(scores)[:5]]
    lists = {}
    for r in got.orderBy("lid", "rank").collect():
        lists.setdefault(r.lid, []).append(r.rid)
    assert lists == want
    assert cells[1] < cells[0] / 2


def test_sample_by_threshold_is_exact_without_a_range_exchange(spark, monkeypatch):
    df = spark.range(0, 5000).withColumnRenamed("id", "k").withColumn("x", F.lit("row"))
    want = sorted(r.k for r in sampling.sample_exact(df, 1200, "k").collect())
    monkeypatch.setattr(sampling, "TAKE_ORDERED_MAX", 3)
    monkeypatch.setattr(sampling, "DRAW_BINS", 8)
    got = sampling.sample_exact(df, 1200, "k")
    assert sorted(r.k for r in got.collect()) == want
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert sampling.sample_exact(df, 9000, "k").count() == 5000
    repeated = spark.createDataFrame([(7, i) for i in range(40)] + [(8, 0), (9, 0)], "k long, i long")
    assert sampling.sample_exact(repeated, 20, "k").count() == 20
    names = df.withColumn("k", F.concat(F.lit("id"), F.col("k").cast("string")))
    assert sampling.sample_exact(names, 100, "k").count() == 100


def test_wide_export_of_all_products_reads_back(spark, tmp_dir):
    m = neighbours.rating_matrix(T.interactions(spark, "/root/testdata/sf0.01")).checkpoint()
    n = files.export_wide_matrix(m, f"{tmp_dir}/wide")
    assert n == 2000
    lines = spark.read.text(f"{tmp_dir}/wide").collect()
    header = next(r.value for r in lines if r.value.startswith("user_id,")).split(",")
    assert [int(c) for c in header[1:]] == sorted(int(c) for c in header[1:])
    got = {}
    for line in {r.value for r in lines if not r.value.startswith("user_id,")}:
        user, *values = line.split(",")
        assert len(values) == 2000
        got |= {(int(user), int(c)): float(v) for c, v in zip(header[1:], values, strict=True) if v != "0.0"}
    assert got == {(r.user_id, r.product_id): r.rating for r in m.collect() if r.rating != 0}


def test_wide_export_of_odd_rows(spark, tmp_dir):
    m = spark.createDataFrame([('a,"b', "p\n1", 2.0), ("c", "p2", None), (None, "p2", 1.0), ("c", None, 1.0)],
                              "user_id string, product_id string, rating double")
    assert files.export_wide_matrix(m, f"{tmp_dir}/odd") == 2
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_dir}/odd").collect()
    assert {tuple(r) for r in back} == {('a,"b', "2.0", "0.0"), ("c", "0.0", "0.0")}
    assert files.export_wide_matrix(m.limit(0), f"{tmp_dir}/none") == 0


def test_half_a_model_is_never_seen(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "red car"), (2, "blue car"), (3, "red boat")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "red boat")], "request_key long, query string")
    model = tfidf.fit(docs)
    assert tfidf.save(model, f"{tmp_dir}/m") == 1
    want = sorted(map(tuple, content.search(model, queries).collect()))
    other = tfidf.fit(docs.withColumn("text", F.lit("nothing here")))
    broken = models.write_tables(spark, f"{tmp_dir}/m", {"weights": other.weights, "idf": other.idf})  # killed before the manifest
    assert sorted(map(tuple, content.search(tfidf.load(spark, f"{tmp_dir}/m"), queries).collect())) == want
    assert tfidf.save(other, f"{tmp_dir}/m") == broken + 1
    assert content.search(tfidf.load(spark, f"{tmp_dir}/m"), queries).collect() == []
    assert sorted(map(tuple, content.search(tfidf.load(spark, f"{tmp_dir}/m", 1), queries).collect())) == want
    assert models.versions(spark, f"{tmp_dir}/m") == [1, broken + 1]
    with pytest.raises(ValueError):
        factors.load(spark, f"{tmp_dir}/m")
    with pytest.raises(FileNotFoundError):
        tfidf.load(spark, f"{tmp_dir}/none")


def test_damaged_files_go_to_quarantine(spark, tmp_dir):
    lines = ["id\tname\tprice", "1\tgood\t2.5", "2\tshort", "3\tlong\t1.0\tmore", '4\t"broken\t1.0', "5\tword\tcheap", "6\t\t", "x\ty\tz"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_dir}/raw")
    clean, bad = files.ingest_delimited(spark, f"{tmp_dir}/raw", "id int, name string, price double", f"{tmp_dir}/out", sep="\t")
    assert sorted((r.id, r.name, r.price) for r in clean.collect()) == [(1, "good", 2.5), (6, None, None)]
    assert {r.record.split("\t")[0] for r in bad.collect()} == {"2", "3", "4", "5", "x"}
    assert clean.count() + bad.count() == len(lines) - 1
    assert clean.select("id").count() == 2  # fewer columns read, same rows


def test_united_sketches_stay_within_their_error(spark):
    df = spark.range(0, 60000).select((F.col("id") % 7).alias("p"), (F.col("id") % 20011).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    got = {r.column_name: r.estimate for r in profile.distinct_estimates(profile.distinct_sketches(df, "p", ["a", "b"])).collect()}
    for name, exact in (("a", 20011), ("b", 30000)):
        assert abs(got[name] - exact) <= profile.SKETCH_ERROR * exact


def test_a_hub_neighbour_is_dealt_over_parts(spark):
    rng = np.random.default_rng(3)
    m = [(0, p, 1.0 + p % 5) for p in range(300)] + [(u, int(p), 2.0) for u in range(1, 90) for p in rng.choice(400, 6, replace=False)]
    matrix = spark.createDataFrame(m, "user_id long, product_id long, rating double")
    nb = spark.createDataFrame([(u, 0, 0.5) for u in range(1, 31)] + [(u, u % 40 + 40, 0.25) for u in range(1, 80)],
                               "user_id long, neighbour_id long, sim double")
    plain = sorted(map(tuple, neighbours.user_based(matrix, nb, 8).collect()))
    dealt = sorted(map(tuple, neighbours.user_based(matrix, nb, 8, hub_products=100).collect()))
    assert plain == dealt and len(plain) > 200


def test_unknown_users_and_exclusion_tables(spark):
    m = T.interactions(spark, SF)
    f = factors.Factors(spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, vec array<double>"), None, np.ones(1))
    asked = spark.createDataFrame([(1,), (7,), (7,), (None,)], "user_id long")
    assert {r.user_id for r in factors.unknown_users(f, asked).collect()} == {7, None}
    pop, cat = popularity.popularity_table(m), T.catalogue(spark, SF)
    first = [r.product_id for r in popularity.trending(pop, cat, n=4).orderBy("rank").collect()]
    out = spark.createDataFrame([(first[0],), (first[2],)], "product_id long")
    by_table = [r.product_id for r in popularity.trending(pop, cat, n=2, exclude_ids=out).orderBy("rank").collect()]
    assert by_table == [first[1], first[3]]
    assert by_table == [r.product_id for r in popularity.trending(pop, cat, n=2, exclude_ids=[first[0], first[2]]).orderBy("rank").collect()]
