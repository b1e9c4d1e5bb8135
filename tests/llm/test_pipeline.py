"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_exact_dedup import plain as exact
from tests.llm.test_packing import invariants

SF = "/root/testdata/sf0.001"


def five_word_sets(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_keepers(docs):
    sets, root = {d: five_word_sets(t) for d, t in docs}, {d: d for d, _ in docs}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = up(a), up(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if up(d) == d}


def test_every_stage_on_its_own_input(spark, tmp_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = docs.limit(2).selectExpr("doc_id + 1000000 AS doc_id", "'%% 12 %%' AS text", "lang", "source", "n_chars")
    docs.unionByName(junk.select(docs.columns)).write.parquet(f"{tmp_dir}/in")
    docs = spark.read.parquet(f"{tmp_dir}/in")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        rows = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        if name == "packing":
            invariants(docs.collect(), {d: (rows[d].source, "".join(t.split()), len(t.split())) for d, t in before}, 2048)
            return
        assert docs.columns == columns
        after = docs.collect()
        assert all(tuple(rows[r.doc_id]) == tuple(r) for r in after) and len({r.doc_id for r in after}) == len(after)
        kept = {r.doc_id for r in after}
        want = {
            "language_id": lambda: {d for d, _ in before if d < 1000000},
            "exact_dedup": lambda: {d for d, v in exact(before).items() if v[2]},
            "near_dedup": lambda: near_keepers(before),
            "decontamination": lambda: {d for d, t in before if not contaminated(t, items)[4]},
        }[name]()
        assert kept == want, name
    raise AssertionError("the last stage is the packing")


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "n_words", "bin_id", "bin_offset"] and out.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
