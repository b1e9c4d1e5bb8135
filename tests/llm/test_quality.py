"""The factorisation machine against pair sums, planted rules and held-out labels."""

from __future__ import annotations

import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from tastemap.llm import quality as q

SF = "/root/testdata/sf0.01"


def raw(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_linear_time_score_is_the_sum_over_all_pairs():
    draw = np.random.default_rng(3)
    machine = q.Machine(np.zeros((len(q.STATISTICS), q.BINS - 1)))
    machine.bias = 0.3
    machine.linear[:] = draw.normal(size=len(machine.linear))
    rows = [(draw.choice(len(machine.linear), n, replace=False), draw.normal(size=n).astype(np.float32)) for n in (1, 5, 60)]
    sizes = np.array([len(r[0]) for r in rows])
    got = machine.logits(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes)[0]
    for (places, values), score in zip(rows, got, strict=True):
        want = 0.3 + float(machine.linear[places] @ values)
        for i in range(len(places)):
            for j in range(i):
                want += float(machine.factors[places[i]] @ machine.factors[places[j]]) * float(values[i] * values[j])
        assert abs(want - score) < 1e-3


def test_pairs_decide_what_single_words_cannot():
    """A label that is the exclusive or of two words: no linear model gets beyond half."""
    draw = random.Random(1)
    texts, labels = [], []
    for _ in range(400):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        texts.append(" ".join(["red" if a else "blue", "cat" if b else "dog"]))
        labels.append(float(a != b))
    machine = q.Machine(np.full((len(q.STATISTICS), q.BINS - 1), 1e9))
    rows = [machine.places(*q.text_features(raw(t)), []) for t in texts]
    for _ in range(12):
        machine.fit(rows, np.array(labels), np.ones(len(rows)))
    sizes = np.array([len(r[0]) for r in rows])
    logits = machine.logits(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes)[0]
    assert ((logits > 0) == np.array(labels, bool)).all()


def test_statistics_of_a_text():
    buckets, weights, stats = q.text_features(raw("THE cat cat. sat!\n\nTHE cat cat. sat!\n*** é1"))
    s = dict(zip(q.STATISTICS, stats, strict=True))
    assert np.isclose(np.exp(s["words"]) - 1, 10) and np.isclose(np.exp(s["chars"]) - 1, 43)
    assert np.isclose(s["distinct_words"], 6 / 10) and s["repeated_next"] == 0
    assert np.isclose(s["bare_symbols"], 1 / 10) and np.isclose(s["all_caps"], 2 / 10) and np.isclose(s["symbol_ends"], 1 / 10)
    assert np.isclose(s["distinct_lines"], 2 / 3) and np.isclose(s["stops"], 4 / 10)
    assert len(buckets) == 6 and np.isclose((weights ** 2).sum(), 1)
    assert len(q.text_features(raw(""))[0]) == len(q.text_features(raw(" \n "))[0]) == 0


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.op11_quality_fm(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.98 * len(held) > 50
    good, bad = ([r.score for r in held if r.quality == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.99 * len(good) * len(bad)
    assert q.op11_quality_fm(spark, SF).count() == docs.count()


def test_labels_that_are_held_out_do_not_matter(spark, tmp_dir):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs.limit(300).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).write.parquet(f"{tmp_dir}/documents.parquet")
    scores = []
    for flip in (False, True):
        out = F.when(q.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")) if flip else F.col("quality")
        labels.withColumn("quality", out).write.mode("overwrite").parquet(f"{tmp_dir}/labels.parquet")
        scores.append({r.doc_id: r.score for r in q.op11_quality_fm(spark, tmp_dir).collect()})
    assert scores[0] == scores[1]


def test_fit_does_not_depend_on_partitions_and_is_bounded(spark):
    docs = [(i, f"good words here {i}." if i % 3 else f"bad### {i}### ") for i in range(200)] + [(7, "a"), (7, "b"), (None, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(200)] + [(3, 1), (5, None), (6, 9), (None, 1)]
    frames = (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    one = q.fit_quality(*frames, fit_rows=40)
    two = q.fit_quality(*(f.repartition(7) for f in frames), fit_rows=40)
    assert np.array_equal(one.linear, two.linear) and np.array_equal(one.factors, two.factors)
    small = q.fit_quality(*frames, fit_rows=40, fit_features=200)
    assert 0 < np.count_nonzero(small.linear) < np.count_nonzero(one.linear)


def test_nulls_empty_long_texts_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "good text.", "x", 0.1), (1, "good text.", "x", 0.1), (2, None, "x", 0.1), (3, "", None, None),
                                  (4, "word " * 300_000, "x", 0.1), (None, "🙂 \x00 é", "x", 0.1)],
                                 "doc_id long, text string, meta string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    plain = q.fit_quality(docs, none)
    rows = q.score_quality(docs, plain, keep=["doc_id", "meta"], metadata={"meta": F.col("meta")}).collect()
    assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    one_class = q.fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(0.5 < r.score <= 1 for r in q.score_quality(docs, one_class, keep=["doc_id"]).collect())
    assert q.score_quality(docs.limit(0), plain, keep=["doc_id"]).collect() == []
