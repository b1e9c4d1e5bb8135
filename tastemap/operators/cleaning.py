"""Null handling and in-group fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .catalogue import first_non_null


def fill_constant(df: DataFrame, value, subset) -> DataFrame:
    """P9 ``fillna(value)`` on the listed columns."""
    return df.fillna(value, subset=list(subset))


def impute_mean(df: DataFrame, cols) -> DataFrame:
    """P10 ``fillna(col.mean())`` for numeric columns.

    The means are scalar subqueries (one aggregate job, value inlined), so no
    single-partition window and no join.  Non-numeric columns are rejected
    (the reference's mean of a text column cannot run either).
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for c in cols:
        if not isinstance(types[c], NumericType):
            raise TypeError(f"impute_mean needs a numeric column, {c} is {types[c].simpleString()}")
        mean = df.select(F.avg(c)).scalar()
        out = out.withColumn(c, F.coalesce(F.col(c), mean.cast(types[c])))
    return out


def group_first(df: DataFrame, key: str, cols, order_col: str = "row_pos") -> DataFrame:
    """W1 ``groupby(key)[cols].transform('first')``: every row gets the first
    non-null value of its group (by ``order_col``); null-key rows get null.

    A partial aggregate per key joined back on the key: a key with a third of
    all rows is folded map-side, and AQE splits its side of the join.
    """
    cols = list(cols)
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*first_non_null(cols, order_col))
    firsts = firsts.select(key, *[F.col(c).alias(f"_first_{c}") for c in cols])
    joined = df.join(firsts, key, "left")
    return joined.select(*[F.col(f"_first_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


BUCKET_ROWS = 4096


def _filled(df: DataFrame, key: str, cols: list[str], order_col: str, bucket: int) -> DataFrame:
    """``df`` (no null keys) with ``_f_<c>``, the last non-null value at or before the row, and
    ``_a_<c>``, the first one at or after it.

    Rows are windowed inside ``(key, floor(pos / bucket))`` only.  What flows into a
    bucket from the others is the same problem on one row per bucket, ``bucket``
    times smaller; at the second level one window per key is left over at most
    ``rows / bucket**2`` rows.
    """
    def carried(rows: DataFrame, group: list[str], by: str, last: str, first: str, inclusive: bool) -> DataFrame:
        here = Window.currentRow
        before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, here if inclusive else -1)
        after = Window.partitionBy(*group).orderBy(by).rowsBetween(here if inclusive else 1, Window.unboundedFollowing)
        return rows.select("*", *[F.last(last.format(c), True).over(before).alias(f"_f_{c}") for c in cols],
                           *[F.first(first.format(c), True).over(after).alias(f"_a_{c}") for c in cols])

    def summary(rows: DataFrame, group: list[str], by: str, last: str, first: str) -> DataFrame:
        def known(c):
            return F.when(F.col(c).isNotNull(), F.col(by))
        return rows.groupBy(*group).agg(
            *[F.max_by(last.format(c), known(last.format(c))).alias(f"_last_{c}") for c in cols],
            *[F.min_by(first.format(c), known(first.format(c))).alias(f"_first_{c}") for c in cols])

    base = df.withColumn("_b", F.floor(F.col(order_col) / F.lit(bucket)).cast("long"))
    buckets = summary(base, [key, "_b"], order_col, "{}", "{}").withColumn(
        "_s", F.floor(F.col("_b") / F.lit(bucket)).cast("long"))
    spans = summary(buckets, [key, "_s"], "_b", "_last_{}", "_first_{}")
    into_spans = carried(spans, [key], "_s", "_last_{}", "_first_{}", False).select(
        key, "_s", *[F.col(f"_f_{c}").alias(f"_sf_{c}") for c in cols], *[F.col(f"_a_{c}").alias(f"_sa_{c}") for c in cols])
    into_buckets = carried(buckets, [key, "_s"], "_b", "_last_{}", "_first_{}", False).join(into_spans, [key, "_s"])
    into_buckets = into_buckets.select(key, "_b", *[F.coalesce(f"_f_{c}", f"_sf_{c}").alias(f"_cf_{c}") for c in cols],
                                       *[F.coalesce(f"_a_{c}", f"_sa_{c}").alias(f"_ca_{c}") for c in cols])
    return carried(base, [key, "_b"], order_col, "{}", "{}", True).join(into_buckets, [key, "_b"]).select(
        *df.columns, *[F.coalesce(f"_f_{c}", f"_cf_{c}").alias(f"_f_{c}") for c in cols],
        *[F.coalesce(f"_a_{c}", f"_ca_{c}").alias(f"_a_{c}") for c in cols])


def group_ffill_bfill(df: DataFrame, key: str, cols, order_col: str = "row_pos",
                      bucket: int = BUCKET_ROWS) -> DataFrame:
    """W2 ``transform(lambda g: g.ffill().bfill())``: the last non-null value
    at or before the row (by ``order_col``), else the first one after it;
    null-key rows form no group and get null.

    A key that holds a third of all rows is cut into buckets of positions (see
    ``_filled``) and is never one task.  Null-key rows bypass the windows.
    ``order_col`` must be numeric and unique within a key.
    """
    cols = list(cols)
    filled = _filled(df.filter(F.col(key).isNotNull()), key, cols, order_col, bucket).select(
        *[F.coalesce(f"_f_{c}", f"_a_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
    keyless = df.filter(F.col(key).isNull()).select(
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) if c in cols else F.col(c) for c in df.columns])
    return filled.unionByName(keyless)
