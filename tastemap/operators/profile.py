"""Data profiling (A3-A7): null counts, distinct counts, column summaries.

Every profile is one partial+final aggregation over the whole table (no
per-column job loop, nothing collected): a value or column holding a third of
all rows is folded map-side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import SCORE_DECIMALS, half_up_array


def shape(df: DataFrame) -> DataFrame:
    """A7 ``df.shape``: ``(row_count, column_count)``."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """A4/A6 ``isnull().sum()`` + ``info()``: one row per column with its type,
    row count, non-null and null counts."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', '{types[c]}', _nn{i}" for i, c in enumerate(cols))
    return wide.selectExpr("_rows AS row_count", f"stack({len(cols)}, {stack}) AS (column_name, data_type, non_null_count)") \
               .select("column_name", "data_type", "row_count", "non_null_count",
                       (F.col("row_count") - F.col("non_null_count")).alias("null_count"))


def _long(df: DataFrame, cols, cast: str) -> DataFrame:
    stack = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, value)")


def string_summary(df: DataFrame, cols) -> DataFrame:
    """A3/A5 (describe of text columns): non-null ``count``, ``unique``, the most
    frequent value ``top`` (ties: smallest value) and its ``freq``.

    Long form ``(column_name, value)`` -> value counts -> one row per column.
    """
    counts = (_long(df, cols, "STRING").filter(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).alias("top"),
        F.max("n").alias("freq"),
    )


QUARTILES = (0.25, 0.5, 0.75)


#: Bins that a bracket is cut into in one pass.
BINS = 4096
#: Accuracy of the sketch that seeds the brackets: ranks are off by at most ``n / ACCURACY``.
ACCURACY = 10_000


def _ends(df: DataFrame, cols: list[str], probs: list[float]) -> dict[int, dict]:
    """One pass over all columns: moments, and for each wanted quantile a bracket from a mergeable quantile sketch."""
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)})
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, around, ACCURACY).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    return {i: {"n": row[f"n{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "at": dict(zip(around, row[f"q{i}"], strict=True))}
            for i in range(len(cols)) if row[f"n{i}"]}


def quantiles(df: DataFrame, cols, probs=QUARTILES, bins: int = BINS) -> DataFrame:
    """Exact quantiles with linear interpolation (``describe``'s 25/50/75 %):
    ``(column_name, q<pct>...)``, without sorting a column.

    The values around rank ``(n - 1) * p`` are found in three passes, or more on
    very large tables.  A quantile sketch gives a narrow bracket of values around
    each wanted rank.  One pass counts exactly what lies below each bracket.  The
    next cuts the bracket into ``bins`` even bins and counts them, with the least
    and the greatest value in each (a partial aggregate of fixed size); the bin
    that holds the rank is the next bracket, until it holds one value only.  A
    rank that the sketch missed is sought between the column's ends instead, so
    the result never depends on the sketch.  What reaches the driver is at most
    ``bins`` rows for each open bracket, whatever the number of rows.  Nulls and
    NaN are left out; a column without values gives no row.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    spark = df.sparkSession
    ends = _ends(df, cols, probs)
    names = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(cols))
    longv = df.selectExpr(f"stack({len(cols)}, {names}) AS (ci, v)").filter("v IS NOT NULL AND NOT isnan(v)")
    found: dict[tuple[int, int], float] = {}
    seeds = {}
    for ci, r in ends.items():
        for p in probs:
            low, high = (r["at"][min(1.0, max(0.0, p + d))] for d in (-2 / ACCURACY, 2 / ACCURACY))
            for rank in (math.floor((r["n"] - 1) * p), math.ceil((r["n"] - 1) * p)):
                seeds[ci, rank] = (low, high)
    places = sorted({(ci, *b) for (ci, _), b in seeds.items()})
    counts = [] if not places else df.agg(*(
        F.count_if((F.col(cols[ci]).cast("double") < e) if below else (F.col(cols[ci]).cast("double") <= e)).alias(f"c{k}_{below}")
        for k, (ci, low, high) in enumerate(places) for below, e in ((1, low), (0, high)))).first()
    wanted = {}
    for (ci, rank), b in seeds.items():
        k = places.index((ci, *b))
        below, upto = counts[f"c{k}_1"], counts[f"c{k}_0"]
        wanted[ci, rank] = (*b, below) if below <= rank < upto else (ends[ci]["lo"], ends[ci]["hi"], 0)
    while True:
        found |= {target: lo for target, (lo, hi, _) in wanted.items() if lo == hi}
        wanted = {t: b for t, b in wanted.items() if t not in found}
        if not wanted:
            break
        brackets = sorted({(ci, *b) for (ci, _), b in wanted.items()})
        v, cases = F.col("v"), []
        for k, (ci, lo, hi, _) in enumerate(brackets):
            width = (hi - lo) / bins
            if math.isfinite(width) and width > 0:
                place = F.least(F.floor((v - lo) / width).cast("int"), F.lit(bins - 1))
            else:  # infinite or adjacent ends
                place = F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(1)
            cases.append(F.when((F.col("ci") == ci) & (v >= lo) & (v <= hi), F.struct(F.lit(k).alias("k"), place.alias("bin"))))
        counted = (longv.select("v", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("b"))
                   .groupBy("b.k", "b.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                   .orderBy("k", "bin").collect())  # brackets * bins rows at most
        for (ci, rank), (lo, hi, below) in list(wanted.items()):
            at, k = below, brackets.index((ci, lo, hi, below))
            for r in (r for r in counted if r["k"] == k):
                if rank < at + r["n"]:
                    wanted[ci, rank] = (r["lo"], r["hi"], at)
                    break
                at += r["n"]
    rows = []
    for ci, r in sorted(ends.items()):
        row = [cols[ci]]
        for p in probs:
            h = (r["n"] - 1) * p
            low, high = found[ci, math.floor(h)], found[ci, math.ceil(h)]
            q = low if low == high else low + (h - math.floor(h)) * (high - low)
            row.append(float(half_up_array(np.array(q))))
        rows.append(tuple(row))
    fields = ", ".join(f"q{round(p * 100)} double" for p in probs)
    return spark.createDataFrame(rows, f"column_name string, {fields}")  # one row a column


def numeric_summary(df: DataFrame, cols, with_quantiles: bool = True) -> DataFrame:
    """A5 (describe of numeric columns): count, mean, sample std, min, the
    25/50/75 % quantiles (exact, linear interpolation) and max."""
    longv = _long(df, cols, "DOUBLE")
    r = lambda c: F.round(c, SCORE_DECIMALS)
    stats = longv.groupBy("column_name").agg(
        F.count("value").alias("count"),
        r(F.avg("value")).alias("mean"),
        r(F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    if not with_quantiles:
        return stats
    return stats.join(quantiles(df, cols), "column_name", "left")


#: Size of a stored distinct-count sketch (2 ** SKETCH_BITS registers); its standard error is about 0.8 %.
SKETCH_BITS = 14
#: Stated error of the united sketches: three standard errors.
SKETCH_ERROR = 0.025


def distinct_sketches(df: DataFrame, part_col: str, cols) -> DataFrame:
    """A3 over parts: one mergeable distinct sketch per part and column, ``(part, column_name, sketch)``, to be
    stored next to the data, so new parts are sketched and old ones never read again.  Nulls do not count."""
    wide = df.groupBy(F.col(part_col).alias("part")).agg(
        *(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"s{i}") for i, c in enumerate(cols)))
    stack = ", ".join(f"'{c}', s{i}" for i, c in enumerate(cols))
    return wide.selectExpr("part", f"stack({len(cols)}, {stack}) AS (column_name, sketch)")


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """``(column_name, estimate)`` of all parts together, within ``SKETCH_ERROR`` of the exact count but for rare chance."""
    return sketches.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
