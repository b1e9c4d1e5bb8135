"""Seeded sampling and synthetic data.

All draws come from ``hashing.md5_draw`` on (key, draw number, seed), so a
result does not depend on partitioning or retries and can be checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import DRAW_RANGE, md5_draw, randint
from ..functions.text import format_id
from .lookup import dense_index


def generated_ids(spark: SparkSession, prefix: str, start: int, stop: int, col: str = "user_id") -> DataFrame:
    """S8 ``[f"{prefix}{i}" for i in range(start, stop)]`` as a distributed range."""
    return spark.range(start, stop).select(format_id(prefix, "id").alias(col))


#: Rows that one ordered take may hold, and bins that a range of draws is cut into in one pass.
TAKE_ORDERED_MAX = 100_000
DRAW_BINS = 4096


def sample_exact(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """G1 ``sample(n, random_state)`` without replacement: the ``n`` rows with
    the smallest draw (ties by key; of rows that share a key any).

    Up to ``TAKE_ORDERED_MAX`` rows: ``orderBy().limit()`` (each task keeps at
    most ``n`` rows, one task merges them).  For a larger sample the ``n``-th
    draw is found first: passes that count draws by bin (a partial aggregate of
    fixed size) narrow its range until an ordered take can end it; the sample
    is then a filter, so its rows are neither sorted nor shuffled.
    """
    drawn = df.withColumn("_h", md5_draw(key_col, seed=seed))
    if n <= TAKE_ORDERED_MAX:
        return drawn.orderBy("_h", key_col).limit(n).drop("_h")
    low, width, left = 0, DRAW_RANGE, n  # the n-th row is the left-th of [low, low + width)
    while True:
        step = max(1, width // DRAW_BINS)
        here = drawn.filter((F.col("_h") >= low) & (F.col("_h") < low + width))
        bins = (here.groupBy(F.expr(f"(_h - {low}) DIV {step}").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                .orderBy("bin").collect())  # about DRAW_BINS rows
        for r in bins:
            if left <= r["n"]:
                low, width, inside = low + r["bin"] * step, step, r["n"]
                break
            left -= r["n"]
        else:
            return df  # fewer than n rows
        if inside <= TAKE_ORDERED_MAX or width == 1:
            break
    head = drawn.filter((F.col("_h") >= low) & (F.col("_h") < low + width))
    if inside <= TAKE_ORDERED_MAX:
        last = head.orderBy("_h", key_col).limit(left).agg(
            F.max(F.struct(F.col("_h").alias("h"), F.col(key_col).alias("k"))).alias("m")).first()["m"]
    else:  # one draw, so one key but for collisions of draws
        last = head.agg(F.min(F.struct(F.col("_h").alias("h"), F.col(key_col).alias("k"))).alias("m")).first()["m"]
    edge = F.struct(F.col("_h").alias("h"), F.col(key_col).alias("k"))
    at = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).cast(df.schema[key_col].dataType).alias("k"))
    before = drawn.filter(edge < at)
    equal = left - head.filter(edge < at).count()
    return before.unionByName(drawn.filter(edge == at).limit(equal)).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, key_col: str, seed: int = 42) -> DataFrame:
    """G3 ``sample(frac)``: keep a row when its draw falls below ``fraction``.
    A pure filter (no shuffle); the count is ``fraction * N`` in expectation."""
    return df.filter(md5_draw(key_col, seed=seed) < F.lit(int(fraction * DRAW_RANGE)))


def sample_with_replacement(df: DataFrame, n: int, order_col: str, seed: int = 42,
                            draw_col: str = "draw_no") -> DataFrame:
    """G2 ``sample(n, replace=True).reset_index(drop=True)``: draw ``d`` picks
    the row at dense position ``md5(d|seed) mod N`` (rows numbered in
    ``order_col`` order).  ``N`` is a scalar subquery; draws join on position."""
    indexed = dense_index(df, order_col, "_pos")
    n_rows = indexed.select(F.count(F.lit(1))).scalar()
    draws = (df.sparkSession.range(n).select(F.col("id").alias(draw_col))
             .withColumn("_pos", F.pmod(md5_draw(draw_col, seed=seed), n_rows)))
    return draws.join(indexed, "_pos").drop("_pos")


def assign_from_domain(df: DataFrame, domain: DataFrame, key_col: str, value_col: str, seed: int = 42,
                       salt: str = "assign") -> DataFrame:
    """G4 ``np.random.choice(domain, size)``: each row gets the domain value at
    position ``md5(key|salt|seed) mod |domain|`` (domain numbered by value)."""
    dom = dense_index(domain.select(value_col).distinct(), value_col, "_pos")
    size = dom.select(F.count(F.lit(1))).scalar()
    picked = df.withColumn("_pos", F.pmod(md5_draw(key_col, F.lit(salt), seed=seed), size))
    return picked.join(dom, "_pos").drop("_pos")


def distinct_draws(keys: DataFrame, key_col: str, items: DataFrame, item_col: str, k: int,
                   seed: int = 42, rank_col: str = "rank") -> DataFrame:
    """G6/G7 ``choice(items, k, replace=False)`` per key, without a cross join.

    Draw ``j`` of key ``u`` picks item position ``md5(u|j|seed) mod N``; the
    first ``k`` distinct positions by draw number are kept.  ``2k`` draws are
    tried at once; the rare keys that still have fewer than ``k`` distinct items
    draw the next batch, until every key has ``min(k, N)``.
    """
    spark = keys.sparkSession
    indexed = dense_index(items.select(item_col).distinct(), item_col, "_pos")
    n_items = indexed.select(F.count(F.lit(1))).first()[0]
    want = min(k, n_items)
    users = keys.select(key_col).distinct()
    batch = 2 * max(want, 1)
    start, firsts, pending = 0, None, users
    while True:
        draws = (pending.withColumn("_j", F.explode(F.sequence(F.lit(start), F.lit(start + batch - 1))))
                 .withColumn("_pos", F.pmod(md5_draw(key_col, "_j", seed=seed), F.lit(n_items))))
        # former draws are read back, not drawn again
        drawn = draws if firsts is None else firsts.unionByName(draws.select(firsts.columns))
        firsts = drawn.groupBy(key_col, "_pos").agg(F.min("_j").alias("_j")).checkpoint()
        short = firsts.groupBy(key_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < want)
        if want == 0 or short.isEmpty():
            break
        pending = short.select(key_col)
        start += batch
    w = Window.partitionBy(key_col).orderBy("_j")
    top = firsts.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= want)
    # both sides by shuffle: the planner guesses the items from the size of their file and would send them all through the driver
    return top.join(indexed.hint("shuffle_merge"), "_pos").select(key_col, F.col(item_col), rank_col)


def synthetic_ratings(pairs: DataFrame, user_col: str, item_col: str, lo: int = 1, hi: int = 6,
                      seed: int = 42, rating_col: str = "rating") -> DataFrame:
    """G5/G7 ratings ``randint(lo, hi)`` per (user, item)."""
    return pairs.withColumn(rating_col, randint(lo, hi, user_col, item_col, F.lit("rating"), seed=seed))
