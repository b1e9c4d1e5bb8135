"""The registered queries of this part, and their SQL on small tables."""

from __future__ import annotations

import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator_and_the_pipeline():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_exact_dedup", "op10_chat_format",
                                  "op12_spelling_variants", "op13_conversation_repair"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    def plain(frame):  # pandas turns integers with nulls into floats
        return sorted(repr([None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in row])
                      for row in frame[columns].astype(object).to_numpy().tolist())

    assert plain(got) == plain(want)
