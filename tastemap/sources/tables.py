"""Parquet test tables and the adapters that turn them into canonical frames.

Canonical frames (see FIXTURES.md):

* catalogue    ``product_id, name, brand, category, image_url, tags, row_pos``
* interactions ``user_id, product_id, rating``

Adapters only select and rename, so Catalyst prunes the scan to the columns
used and pushes any later filter into the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalogue_from_part(part: DataFrame) -> DataFrame:
    """``part`` as a product catalogue; ``row_pos`` is the part key."""
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("image_url"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("tags"),
        F.col("p_partkey").alias("row_pos"),
    )


def interactions_from_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Long ratings table: customer rates part with the line quantity.

    lineitem and orders are both large; this is a shuffle join on the order
    key (co-located for free when both are bucketed by order key).
    """
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    od = orders.select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("rating"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_from_part(table(spark, sf_dir, "part"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_from_orders(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text corpus ``doc_id, text`` (``doc_id`` doubles as the row position)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vec array<double>`` from the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
