"""Id mapping and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, order_col: str, index_col: str = "idx", partitions: int | None = None) -> DataFrame:
    """Attach ``0..N-1`` in ``order_col`` order (ties are not allowed:
    ``order_col`` must be unique, e.g. a distinct id or a row position).

    No single-partition window: the rows are range-partitioned and sorted,
    each partition's rows are numbered locally with
    ``monotonically_increasing_id`` (consecutive inside a partition), and a
    per-partition offset table (one row per partition, broadcast) is added.
    The tagged rows are checkpointed to the cluster's checkpoint folder first,
    so partition ids cannot change between the two uses and a lost executor
    recomputes nothing.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n_parts, F.col(order_col)).sortWithinPartitions(order_col)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_local", F.col("_local") - F.shiftleft(F.col("_pid").cast("long"), 33))
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_offset"))


def id_index(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """M5: ``(id, idx)`` with ``idx`` the lexicographic rank of the id string
    (``USER_0, USER_1, USER_10, USER_2`` -> 0, 1, 2, 3)."""
    distinct = ids.select(F.col(id_col).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()
    return dense_index(distinct, "id")


def encode(df: DataFrame, id_col: str, mapping: DataFrame, index_col: str = "idx") -> DataFrame:
    """J2 encode: replace ``id_col`` by its index (inner join; unknown ids drop,
    see ``unknown_ids``).  The mapping grows with the id domain, so no
    broadcast hint: AQE broadcasts it when its measured size is small."""
    m = mapping.select(F.col("id").alias("_id"), F.col("idx").alias(index_col))
    return df.join(m, F.col(id_col).cast("string") == F.col("_id"), "inner").drop("_id")


def decode(df: DataFrame, index_col: str, mapping: DataFrame, id_col: str = "id") -> DataFrame:
    """J2 decode: index back to id by an equi-join (not a reverse scan)."""
    m = mapping.select(F.col("idx").alias("_idx"), F.col("id").alias(id_col))
    return df.join(m, F.col(index_col) == F.col("_idx"), "inner").drop("_idx")


def unknown_ids(requests: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Requested ids missing from the known set (``left_anti``)."""
    return requests.select(id_col).distinct().join(known.select(id_col).distinct(), id_col, "left_anti")


def known_requests(requests: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """P14 complement: requests whose id is known (``left_semi``)."""
    return requests.join(known.select(id_col).distinct(), id_col, "left_semi")


def missing_ids(ids: DataFrame, catalogue: DataFrame, id_col: str = "product_id") -> DataFrame:
    """``set(ids) - set(catalogue.ids)``."""
    return ids.select(id_col).distinct().join(catalogue.select(id_col), id_col, "left_anti")


def requests_without_results(requests: DataFrame, results: DataFrame, key_col: str) -> DataFrame:
    """P15 batch form of ``df.empty``: requests that got no result row."""
    return requests.select(key_col).distinct().join(results.select(key_col).distinct(), key_col, "left_anti")
