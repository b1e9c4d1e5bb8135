"""Catalogue operators: keep-first details, point lookup, fetch by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETAIL_COLS = ("name", "brand", "category", "image_url")


def first_non_null(cols, order_col: str = "row_pos"):
    """A1 ``first``: per group, first non-null value of each column by ``order_col``.

    ``min_by`` skips rows whose ordering is null, so rows where the value is
    null are skipped by nulling their order.  A partial aggregate: a group of
    any size is folded map-side before the shuffle.
    """
    return [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in cols]


def details(catalogue: DataFrame, ids: DataFrame | None = None, cols=DETAIL_COLS) -> DataFrame:
    """One row per ``product_id`` with the first non-null detail values.

    ``ids`` (a ranked result, bounded by its ``n``) restricts the catalogue by
    a semi-join before the aggregation, so only requested products shuffle.
    A detail column that the catalogue lacks (``image_url`` is optional) is null.
    """
    cat = catalogue
    for c in cols:
        if c not in catalogue.columns:
            cat = cat.withColumn(c, F.lit(None).cast("string"))
    if ids is not None:
        cat = cat.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    return cat.groupBy("product_id").agg(*first_non_null(list(cols)))


def with_details(ranked: DataFrame, catalogue: DataFrame, id_col: str = "product_id") -> DataFrame:
    """A ranked list with the catalogue details of ``id_col``; a product
    without a catalogue row keeps its place with null details."""
    det = details(catalogue).withColumnRenamed("product_id", "_detail_id")
    return ranked.join(det, F.col(id_col) == F.col("_detail_id"), "left").select(*ranked.columns, *DETAIL_COLS)


def dedup_first(df: DataFrame, key_cols, order_col: str = "row_pos") -> DataFrame:
    """A9 ``drop_duplicates(keep='first')``: the row with the smallest ``order_col``
    per key, whole.  ``min_by(struct)`` is a partial aggregate, so a key with a
    third of all rows (a group of copies) is folded map-side."""
    if isinstance(key_cols, str):
        key_cols = [key_cols]
    others = [c for c in df.columns if c not in key_cols]
    packed = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_first")
    return df.groupBy(*key_cols).agg(packed).select(*key_cols, *[F.col(f"_first.{c}").alias(c) for c in others])


def point_lookup(df: DataFrame, id_col: str, requests: DataFrame, order_col: str = "row_pos") -> DataFrame:
    """P5 ``df[df.id == x].index[0]`` for a table of requested ids: the first
    position of each requested id (requests join, no driver loop)."""
    firsts = df.join(requests.select(id_col).distinct(), id_col, "left_semi") \
               .groupBy(id_col).agg(F.min(order_col).alias(order_col))
    return firsts


def fetch_by_position(df: DataFrame, positions: DataFrame, order_col: str = "row_pos") -> DataFrame:
    """P12 ``df.iloc[positions]``: inner join on the explicit row position;
    the caller's rank column keeps the requested order."""
    return positions.join(df, order_col, "inner")


def distinct_first_seen(df: DataFrame, value_col: str, order_col: str = "row_pos") -> DataFrame:
    """A8/U1 ``col.unique()``: each distinct non-null value with the position
    where it first occurs and its first-seen order (``seen_order``, 1-based).

    First positions are a partial aggregate; the order number comes from the
    distributed dense index (range partitions plus per-partition offsets), so
    a column with billions of distinct values is never numbered in one task.
    """
    from .lookup import dense_index

    firsts = df.filter(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.min(order_col).alias("first_pos"))
    ranked = dense_index(firsts, "first_pos", "seen_order")
    return ranked.select(value_col, "first_pos", (F.col("seen_order") + 1).alias("seen_order"))
