"""Ranking helpers shared by every recommender.

Every ranking in the library is ``ORDER BY score DESC NULLS LAST, id ASC`` on a
score rounded to ``SCORE_DECIMALS`` so that near-equal floats computed in a
different order rank the same way in every engine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DECIMALS = 6


def half_up(col: Column | str, decimals: int = SCORE_DECIMALS) -> Column:
    """``col`` rounded half away from zero by plain double arithmetic.

    ``half_up_array`` does the same operations in NumPy, so a score rounds alike
    whichever plan computed it.
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** decimals)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale + 0.0  # no negative zero


def half_up_array(values: np.ndarray, decimals: int = SCORE_DECIMALS) -> np.ndarray:
    scale = float(10 ** decimals)
    return np.sign(values) * np.floor(np.abs(values) * scale + 0.5) / scale + 0.0


def top_n_per_group(df: DataFrame, group_cols: list[str] | str, score_col: str, id_col: str,
                    n: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``n`` rows per group by score desc (nulls last), id asc.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each map task keeps
    at most ``n`` rows per group before the shuffle, so even a group holding a
    third of all rows ships only ``n`` rows per task.
    """
    if isinstance(group_cols, str):
        group_cols = [group_cols]
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc_nulls_last(), F.col(id_col).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def top_n(df: DataFrame, score_col: str, id_col: str, n: int, rank_col: str = "rank") -> DataFrame:
    """Global top ``n``: ``orderBy().limit()`` (TakeOrderedAndProject, per-task
    top-n then a merge of n rows per task), rank attached afterwards on the n
    rows only."""
    top = df.orderBy(F.col(score_col).desc_nulls_last(), F.col(id_col).asc()).limit(n)
    w = Window.orderBy(F.col(score_col).desc_nulls_last(), F.col(id_col).asc())
    return top.withColumn(rank_col, F.row_number().over(w))


def page_number(rank_col: str = "rank", page_size: int = 3) -> Column:
    """Zero-based page of a 1-based rank."""
    return F.floor((F.col(rank_col) - 1) / page_size).cast("int")
