"""Learned user/item scorer (M6, R10): MLlib ALS on the long rating matrix.

The reference's neural scorer is replaced by Spark's distributed ALS (blocked
alternating least squares).  Ids are mapped to dense int indices first (ALS
needs int ids); recommendations use the same grid scorer as the SVD path, so
the full user x item score matrix is never materialised.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import half_up
from ..session import written
from .factors import Factors
from .lookup import dense_index
from .similarity import dense_top_n


def fit(matrix: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.1, seed: int = 42) -> Factors:
    """Fit ALS on ``(user_id, product_id, rating)``; returns factor tables
    keyed by the original ids (``singular_values`` is empty)."""
    import numpy as np

    matrix = written(matrix)  # read for both indices and the training rows
    users = dense_index(matrix.select("user_id").distinct(), "user_id", "u_idx")
    items = dense_index(matrix.select("product_id").distinct(), "product_id", "i_idx")
    train = written(matrix.join(users, "user_id").join(items, "product_id")
                    .select(F.col("u_idx").cast("int").alias("u_idx"), F.col("i_idx").cast("int").alias("i_idx"),
                            F.col("rating").cast("float").alias("rating")))  # as ALS holds them
    blocks = max(10, int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the items' factors are written in each iteration, which deletes the shuffle files of the one before
    als = ALS(checkpointInterval=1, numUserBlocks=blocks, numItemBlocks=blocks, rank=rank, maxIter=max_iter, regParam=reg, seed=seed, userCol="u_idx", itemCol="i_idx",
              ratingCol="rating", coldStartStrategy="drop", nonnegative=False)
    model = als.fit(train)
    uf = (model.userFactors.join(users, F.col("id") == F.col("u_idx"))
          .select(F.col("user_id").alias("id"), F.col("features").cast("array<double>").alias("vec")))
    itf = (model.itemFactors.join(items, F.col("id") == F.col("i_idx"))
           .select(F.col("product_id").alias("id"), F.col("features").cast("array<double>").alias("vec")))
    return Factors(user_factors=uf, item_factors=itf, singular_values=np.zeros(0))


def recommend(f: Factors, n: int = 10, users: DataFrame | None = None) -> DataFrame:
    """Top ``n`` items per user by predicted rating over all items.
    Returns ``user_id, product_id, rank, predicted_rating``."""
    left = f.user_factors
    if users is not None:
        left = left.join(users.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    res = dense_top_n(left, f.item_factors, n)
    return res.select(F.col("lid").alias("user_id"), F.col("rid").alias("product_id"), "rank",
                      half_up("score").alias("predicted_rating"))
