"""Language identification: held-out accuracy, what each kind of evidence does, grouped priors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from tastemap.llm.language_id import (DECLARED_RIGHT, SMOOTHING, SUFFIX_LANGUAGE, SUFFIX_RIGHT, fit, identify,
                                      keep_identified, op2_language_id, page_rows)

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.col("doc_id") % 5 == 0
    model = fit(docs.filter(~held), text="text", label="lang", row_id="doc_id")
    rows = docs.filter(held & (F.length("text") >= 40)).select(
        "doc_id", "lang", "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    judged = identify(rows.withColumnRenamed("lang", "label"), model, keep=("doc_id", "label")).collect()
    assert len(judged) > 150
    assert np.mean([r.lang == r.label for r in judged]) > 0.99
    assert np.mean([r.kept for r in judged]) > 0.99


def test_whole_tables(spark):
    rows = op2_language_id(spark, SF).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert len(rows) == len(docs) + pages and len({r.doc_id for r in rows}) == len(rows)
    assert {r.doc_id for r in rows if r.doc_id >= 0} == set(docs)
    assert np.mean([docs[r.doc_id] == r.lang and r.kept for r in rows if r.doc_id >= 0]) > 0.995


def _fused(model, rows):
    """The method for a list of ``(text, declared, host)``, one row after the other."""
    size = len(model.languages)
    evidence = [model.evidence(t) for t, _, _ in rows]
    own = []
    for n, ll in evidence:
        p = np.exp(ll - ll.max())
        own.append(p / p.sum() if n else np.zeros(size))
    out = []
    for i, (_, declared, host) in enumerate(rows):
        host = host.lower() if host else None
        levels = [lambda h: True]
        if host and "." in host:
            suffix, domain = host.rsplit(".", 1)[1], ".".join(host.rsplit(".", 2)[-2:])
            levels += [lambda h, s=suffix: "." in h and h.rsplit(".", 1)[1] == s,
                       lambda h, d=domain: "." in h and ".".join(h.rsplit(".", 2)[-2:]) == d]
        else:
            suffix = None
            levels += [lambda h: False, lambda h: False]
        levels.append(lambda h, x=host: h == x)
        prior = np.full(size, 1 / size)
        for k, belongs in enumerate(levels):
            others = [own[j] for j, r in enumerate(rows) if j != i and (k == 0 or (r[2] and belongs(r[2].lower())))]
            counts, weight = np.sum([np.zeros(size), *others], axis=0), size if k == 0 else SMOOTHING
            prior = (counts + weight * prior) / (counts.sum() + weight)
        score = evidence[i][1] + np.log(prior)
        for claim, right in ((declared, DECLARED_RIGHT), (SUFFIX_LANGUAGE.get(suffix), SUFFIX_RIGHT)):
            if claim in model.languages:
                for j, lang in enumerate(model.languages):
                    score[j] += math.log(right if lang == claim else 1 / size if lang == "und"
                                         else (1 - right) / (size - 1))
        p = np.exp(score - score.max())
        out.append((model.languages[int(p.argmax())], round(float(p.max() / p.sum()), 4)))
    return out


def test_fusion_against_the_plain_method(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, text="text", label="lang", row_id="doc_id", fit_rows=100)
    rows = [("the", "de", "a.x.de"), ("the", None, "b.x.de"), ("der und die", None, "a.x.de"), ("le", "fr", "A.x.de"),
            ("que", None, "y.com"), ("que", "zz", "src0"), ("la la la", None, "src0"), ("los que", None, "src0"),
            ("", "en", "src0"), (None, None, None), ("12 %%", "fr", "y.com"), ("of the and of", None, None),
            ("qz" * 400, None, "y.com"), ("the", "de", "a.x.de")]
    df = spark.createDataFrame([Row(i=i, text=t, declared=d, host=h, lang="clash", p=1) for i, (t, d, h) in enumerate(rows)])
    got = {r.i: r for r in identify(df, model, keep=("i",)).collect()}
    assert len(got) == len(rows)
    for i, (lang, posterior) in enumerate(_fused(model, rows)):
        assert got[i].lang == lang and abs(got[i].posterior - posterior) < 2e-4, (i, rows[i], got[i], lang, posterior)
    assert not any(got[i].kept for i in (8, 9, 10, 12))  # no letters, or no language's letters
    assert identify(df.filter("false"), model, keep=("i",)).count() == 0


def test_without_labels_everything_is_rejected(spark):
    rows = spark.createDataFrame([("a word", None, "h", 1)], "text string, lang string, source string, doc_id long")
    assert keep_identified(rows).count() == 0
    assert keep_identified(rows.filter("false")).columns == rows.columns


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("host", F.lit("clash"))
    bad = docs.limit(3).withColumn("text", F.lit("12345 %%% 67")).withColumn("doc_id", F.col("doc_id") + 10 ** 6)
    kept = keep_identified(docs.unionByName(bad).checkpoint())
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(
        r.doc_id for r in docs.select("doc_id").collect())


def test_pages(spark):
    html = '<!doctype html>\n<HTML class=x LANG=\'de\'><script>the the</script><p>Der&amp;Hund</p><!-- the --></html>'
    row = page_rows(spark.createDataFrame([Row(page_id=1, url="https://u@Sub.Host.de:80/x?y", html=html),
                                           Row(page_id=2, url=None, html=None)])).orderBy("page_id").collect()
    assert (row[0].declared, row[0].host, row[0].text.split()) == ("de", "Sub.Host.de", ["Der", "Hund"])
    assert (row[1].declared, row[1].host, row[1].text) == (None, None, None)


def test_more_than_64_languages(spark):
    """Every label has its column in the model, the rarest too."""
    import random

    draw = random.Random(5)
    rows = []
    for i in range(70):
        words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        rows += [(100 * i + k, " ".join(draw.choices(words, k=40)), f"l{i:02d}") for k in range(3 if i % 10 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, text="text", label="lang", row_id="doc_id")
    assert model.languages == [*(f"l{i:02d}" for i in range(70)), "und"]
    judged = identify(docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit("a.example").alias("host")),
                      model, keep=("doc_id",)).collect()
    assert {r.doc_id: (r.lang, r.kept) for r in judged} == {d: (lang, True) for d, _, lang in rows}


def test_labels_and_claims_count_without_case_and_und_is_no_label(spark):
    train = [(i, t, lab) for i, (t, lab) in enumerate([("the cat and the dog", "EN"), ("der hund und die katze", "de"),
                                                        ("el gato y el perro", "zh-CN"), ("zzz qqq", "und")] * 5)]
    labelled = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = fit(labelled, text="text", label="lang", row_id="doc_id")
    assert model.languages == ["de", "en", "zh-cn", "und"]
    asked = [(0, "", "EN", None), (1, "", "en-US", None), (2, "", "zh-CN", None), (3, "", "und", None), (4, "", None, None),
             (5, "the cat and the dog " * 20_000, None, None)]
    rows = spark.createDataFrame(asked, "doc_id long, text string, declared string, host string")
    got = {r.doc_id: (r.lang, r.posterior) for r in identify(rows, model, keep=("doc_id",)).collect()}
    assert [got[i][0] for i in (0, 1, 2, 5)] == ["en", "en", "zh-cn", "en"]
    assert got[0] == got[1] and got[3] == got[4]
