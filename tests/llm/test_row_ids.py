"""Row ids stay with their rows when the file splits change between two jobs, and whatever the frame is."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tastemap.llm import common
from tastemap.llm.decontaminate import drop_contaminated
from tastemap.llm.exact_dedup import drop_exact_copies
from tastemap.llm.language_id import keep_identified
from tastemap.llm.line_dedup import drop_repeated_lines, line_dedup
from tastemap.llm.near_dedup import drop_near_copies, near_groups
from tastemap.llm.packing import pack_documents
from tastemap.llm.pii import personal_data

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nine_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nine") / "documents")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(9).write.parquet(path)
    return path


def split(spark, files):
    """A setting that decides how many files share a task, and so every partition's number."""
    spark.conf.set("spark.sql.files.minPartitionNum", str(files))
    spark.conf.set("spark.sql.files.openCostInBytes", "4194304" if files > 1 else "1")


@pytest.fixture
def shifting(spark, monkeypatch):
    """Splits that change each time an operator asks for its row ids or selects by them."""
    sizes = iter([1, 9, 2, 8, 1, 9] * 50)
    for name in ("with_row_id", "without_rows"):
        plain = getattr(common, name)

        def shifted(*args, plain=plain):
            split(spark, next(sizes))
            return plain(*args)

        monkeypatch.setattr(common, name, shifted)
    yield
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ids_do_not_move_with_the_splits(spark, nine_files):
    docs = spark.read.parquet(nine_files)
    numbered = common.with_row_id(docs)
    seen = []
    for files in (1, 9, 3):
        split(spark, files)
        seen.append(sorted((r[0], r[1], r[2]) for r in numbered.select("_tm_row", "doc_id", F.md5("text")).collect()))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2]
    assert len({r[0] for r in seen[0]}) == docs.count()
    kept = common.with_row_id(docs.filter("doc_id > 50").select("doc_id"))
    assert {tuple(r) for r in kept.select("_tm_row", "doc_id").collect()} <= {r[:2] for r in seen[0]}


def test_frames_that_are_no_scan_are_numbered_once(spark, nine_files):
    draw = random.Random(1)
    docs = spark.read.parquet(nine_files)
    for frame in (docs.unionByName(docs), docs.join(docs.select("doc_id"), "doc_id"), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))),
                  spark.createDataFrame([(draw.random(),) for _ in range(50)], "x double").repartition(3)):
        numbered = common.with_row_id(frame)
        first, second = (sorted(map(repr, numbered.collect())) for _ in range(2))
        assert first == second
        assert numbered.select("_tm_row").distinct().count() == numbered.count() == frame.count()


@pytest.mark.parametrize("drop", [
    drop_exact_copies, lambda d: drop_near_copies(d, words=2), keep_identified, drop_repeated_lines,
    lambda d: drop_contaminated(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet"))])
def test_dropping_does_not_follow_the_splits(spark, nine_files, shifting, drop):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter((r.doc_id, r.text) for r in drop(whole).collect())
    got = Counter((r.doc_id, r.text) for r in drop(spark.read.parquet(nine_files)).collect())
    assert got == want


@pytest.mark.parametrize("report", [near_groups, personal_data, line_dedup, pack_documents])
def test_reports_do_not_follow_the_files(spark, nine_files, shifting, report):
    rows = [sorted(map(repr, report(spark.read.parquet(p)).collect())) for p in (f"{SF}/documents.parquet", nine_files)]
    assert rows[0] == rows[1]


def test_columns_with_reserved_names_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y"), (3, "d", 7, "z")],
                                 "doc_id long, text string, _tm_row long, _TM_row_ string")
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {(1, "a b c", 5, "x"), (3, "d", 7, "z")}
    assert {tuple(r) for r in drop_near_copies(docs, words=2).collect()} == {(1, "a b c", 5, "x"), (3, "d", 7, "z")}
