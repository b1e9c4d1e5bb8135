"""User-based recommendations, popularity and trending lists."""

import pytest
from pyspark.sql import functions as F

from tastemap.operators import neighbours, popularity


def ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id long, product_id long, rating double")


def test_zero_rating_user_has_no_neighbours_and_twins_rank(spark):
    m = neighbours.rating_matrix(ratings(spark, [
        (1, 10, 5.0), (1, 11, 3.0),
        (2, 10, 5.0), (2, 11, 3.0),          # twin of user 1
        (3, 10, 1.0), (3, 12, 4.0),
        (4, 10, 0.0), (4, 11, 0.0),          # only zeros: zero vector
    ]))
    nb = neighbours.similar_users(m, n=2).collect()
    assert not [r for r in nb if 4 in (r["user_id"], r["neighbour_id"])]
    best = {r["user_id"]: r["neighbour_id"] for r in nb if r["rank"] == 1}
    assert best[1] == 2 and best[2] == 1


def test_user_based_scores_and_no_rated_leak(spark):
    m = neighbours.rating_matrix(ratings(spark, [
        (1, 10, 4.0),
        (2, 10, 4.0), (2, 20, 2.0),
        (3, 10, 2.0), (3, 30, 5.0), (3, 20, 1.0),
        (5, 10, 1.0), (5, 20, 1.0), (5, 30, 1.0),   # rated everything
    ]))
    nb = neighbours.similar_users(m, n=2)
    recs = neighbours.user_based(m, nb, n=5)
    got = {(r["user_id"], r["product_id"]): r["score"] for r in recs.collect()}
    assert all(p != 10 for (u, p) in got if u == 1)
    assert not [k for k in got if k[0] == 5]
    sims = {(r["user_id"], r["neighbour_id"]): r["sim"] for r in nb.collect()}
    rat = {(2, 10): 4.0, (2, 20): 2.0, (3, 10): 2.0, (3, 30): 5.0, (3, 20): 1.0,
           (5, 10): 1.0, (5, 20): 1.0, (5, 30): 1.0}
    mine = {v: s for (u, v), s in sims.items() if u == 1}
    assert len(mine) == 2 and 2 in mine                       # n=2 neighbours, twin-like user 2 first
    wsum = sum(mine.values())
    for item in (20, 30):
        want = sum(s * rat.get((v, item), 0.0) for v, s in mine.items()) / wsum   # non-raters weigh in
        if any((v, item) in rat for v in mine):
            assert got[(1, item)] == pytest.approx(round(want, 6))


def test_popular_items_skip_null_ratings_and_keep_first_details(spark):
    inter = ratings(spark, [(1, 1, 5.0), (2, 1, None), (1, 2, 2.0), (2, 2, 2.0), (3, 2, 2.0), (1, 3, 1.0)])
    cat = spark.createDataFrame([
        (1, None, "b1", "c1", "t", 5), (1, "first", "b1", "c1", "t", 6), (1, "second", "b1", "c1", "t", 7),
        (2, "two", "b2", "c2", "t", 1), (3, "three", "b3", "c3", "t", 2)],
        "product_id long, name string, brand string, category string, tags string, row_pos long")
    top = popularity.popular_items(inter, cat, n=2).orderBy("rank").collect()
    assert [r["product_id"] for r in top] == [2, 1]
    assert top[1]["name"] == "first" and top[1]["rating_count"] == 1
    assert top[0]["popularity_score"] == 6.0


def test_trending_excludes_and_pages(spark):
    pop = spark.createDataFrame([(i, float(100 - i)) for i in range(10)], "product_id long, popularity_score double")
    cat = spark.createDataFrame([(i, f"n{i}", "b", "c", "t", i) for i in range(10) if i != 4],
                                "product_id long, name string, brand string, category string, tags string, row_pos long")
    out = popularity.trending(pop, cat, n=7, exclude_ids=[2]).orderBy("rank").collect()
    assert [r["product_id"] for r in out] == [0, 1, 3, 5, 6, 7]        # 2 excluded, 4 has no details
    assert [r["page_no"] for r in out] == [0, 0, 0, 1, 1, 2]
