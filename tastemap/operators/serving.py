"""Batch serving lists (R11) and the catalogue preparation pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_segment
from ..functions.hashing import randint
from . import cleaning, sampling
from .lookup import known_requests


def home_lists(requests: DataFrame, known_users: DataFrame, catalogue: DataFrame, n: int = 12,
               seed: int = 42, ranked: DataFrame | None = None) -> DataFrame:
    """Per requested user (``user_id``, may be null or unknown):

    * known user with rows in ``ranked`` (``user_id, rank, product_id``, any
      recommender's result) -> the first ``n`` of them (``source='personal'``)
    * other known user -> ``n`` seeded random distinct products (``'random'``)
    * otherwise -> the first ``n`` catalogue rows by ``row_pos`` (``'default'``)

    Returns ``user_id, source, rank, product_id``.  The default list is the
    global top-n by position (at most ``n`` rows, broadcast) joined to the
    unknown requests on the rank, an equi-join.
    """
    req = requests.select("user_id").distinct()
    known = known_requests(req.filter(F.col("user_id").isNotNull()), known_users, "user_id")
    drawn = known
    lists = None
    if ranked is not None:
        lists = ranked.filter(F.col("rank") <= n).join(known, "user_id", "left_semi")
        drawn = known.join(lists.select("user_id").distinct(), "user_id", "left_anti")
        lists = lists.select("user_id", F.lit("personal").alias("source"), "rank", "product_id")
    random = sampling.distinct_draws(drawn, "user_id", catalogue.select("product_id"), "product_id", n, seed=seed)
    out = random.select("user_id", F.lit("random").alias("source"), "rank", "product_id")
    if lists is not None:
        out = out.unionByName(lists)
    # left_anti keeps null ids too (a null never matches), i.e. "not logged in"
    unknown = req.join(known, "user_id", "left_anti")
    head = (catalogue.orderBy("row_pos").limit(n).select("product_id", "row_pos")
            .withColumn("rank", F.row_number().over(Window.orderBy("row_pos")))
            .drop("row_pos"))
    default = (unknown.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n))))
               .join(F.broadcast(head), "rank")
               .select("user_id", F.lit("default").alias("source"), "rank", "product_id"))
    return out.unionByName(default)


RAW_COLUMNS = {
    # Raw marketplace column names and the short names they get.
    "Product Id": "ProdID",
    "Product Category": "Category",
    "Product Brand": "Brand",
    "Product Name": "Name",
    "Product Image Url": "ImageURL",
    "Product Description": "Description",
    "Product Tags": "Tags",
}


def prepare_catalogue(raw: DataFrame, user_domain: DataFrame, sample_n: int = 3500, resample_n: int = 6000,
                      seed: int = 42) -> DataFrame:
    """Project -> fill '' -> rename -> seeded sample of ``sample_n`` ->
    per-product first / ffill-bfill of details -> resample ``resample_n`` rows
    with replacement -> assign a random user from ``user_domain`` and a
    rating in ``[0, 5)`` -> keep the first ``>`` segment of the category.

    ``raw`` needs the raw columns plus ``row_pos``; returns the prepared long
    table ``draw_no, ProdID, Category, Brand, Name, ImageURL, Description,
    Tags, user_id, Rating``.
    """
    df = raw.select("row_pos", *RAW_COLUMNS)
    df = cleaning.fill_constant(df, "", ["Product Brand", "Product Description"])
    df = df.withColumnsRenamed(RAW_COLUMNS)
    df = sampling.sample_exact(df, sample_n, "row_pos", seed=seed)
    detail = ["Category", "Brand", "Name", "ImageURL", "Description", "Tags"]
    df = cleaning.group_first(df, "ProdID", detail, order_col="row_pos")
    df = cleaning.group_ffill_bfill(df, "ProdID", detail, order_col="row_pos")
    df = sampling.sample_with_replacement(df, resample_n, "row_pos", seed=seed)
    df = sampling.assign_from_domain(df, user_domain, "draw_no", "user_id", seed=seed)
    df = df.withColumn("Rating", randint(0, 5, "draw_no", F.lit("rating"), seed=seed))
    df = df.withColumn("Category", first_segment("Category"))
    return df.select("draw_no", "ProdID", *detail, "user_id", "Rating")
