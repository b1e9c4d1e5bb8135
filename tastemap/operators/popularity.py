"""Popularity (A10, R1) and trending lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import SCORE_DECIMALS, page_number, top_n
from . import catalogue as cat_ops


def popularity_table(interactions: DataFrame) -> DataFrame:
    """``product_id, avg_rating, rating_count, popularity_score``.

    ``avg * count`` as the reference defines it (equals ``sum`` up to float
    noise); nulls are skipped by both aggregates.  One partial+final hash
    aggregate: a product holding a third of all rows is folded map-side.
    """
    agg = interactions.groupBy("product_id").agg(
        F.avg("rating").alias("avg_raw"), F.count("rating").alias("rating_count"))
    return agg.select(
        "product_id",
        F.round("avg_raw", SCORE_DECIMALS).alias("avg_rating"),
        "rating_count",
        F.round(F.col("avg_raw") * F.col("rating_count"), SCORE_DECIMALS).alias("popularity_score"),
    )


def popular_items(interactions: DataFrame, catalogue: DataFrame, n: int = 12) -> DataFrame:
    """Top ``n`` products by popularity score (ties by id), with details.

    Details are looked up after the top-n, for the ``n`` winners only (broadcast
    of at most ``n`` ids); products without a catalogue row keep null details.
    """
    # n rows, read by two branches (result and catalogue filter): written down
    # so the interactions join and aggregate run once
    top = top_n(popularity_table(interactions), "popularity_score", "product_id", n).checkpoint()
    det = cat_ops.details(catalogue, F.broadcast(top.select("product_id")))
    return top.join(F.broadcast(det), "product_id", "left").select(
        "rank", "product_id", *cat_ops.DETAIL_COLS, "avg_rating", "rating_count", "popularity_score")


def trending(popularity: DataFrame, catalogue: DataFrame, n: int = 13, exclude_ids=(),
             page_size: int = 3) -> DataFrame:
    """R2: top ``n`` of a precomputed popularity table, minus excluded ids (P13:
    a short list, or a table ``(product_id)`` of any size, which is anti-joined),
    joined to catalogue details by product id (inner, J9), in pages (W4)."""
    pop = popularity
    if isinstance(exclude_ids, DataFrame):
        pop = pop.join(exclude_ids.select("product_id"), "product_id", "left_anti")
    elif exclude_ids:
        pop = pop.filter(~F.col("product_id").isin(list(exclude_ids)))
    top = top_n(pop.select("product_id", "popularity_score"), "popularity_score", "product_id", n).checkpoint()
    det = cat_ops.details(catalogue, F.broadcast(top.select("product_id")))
    return (top.join(F.broadcast(det), "product_id", "inner")
            .select("rank", page_number("rank", page_size).alias("page_no"), "product_id",
                    *cat_ops.DETAIL_COLS, "popularity_score"))
