"""Query catalogue: every registered query runs on the whole test tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the pre-registered views) share column names and rounding.  Queries
without an oracle are iterative fits; they are checked by their own tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ranking import half_up, top_n_per_group
from ..operators import catalogue as catalogue_ops
from ..operators import als, cleaning, content, factors, lookup, neighbours, popularity, profile, sampling, serving, tfidf
from ..operators.similarity import dense_top_n
from ..session import ensure_checkpoint_dir, written
from ..sources import files
from ..sources import tables as T
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- R1

@register("popular_items", f"""
WITH i AS ({O.INTERACTIONS}),
p AS (SELECT product_id, avg(rating) AS a, count(rating) AS c FROM i GROUP BY product_id),
s AS (SELECT product_id, round(a, 6) AS avg_rating, c AS rating_count, round(a * c, 6) AS popularity_score FROM p),
r AS (SELECT *, {O.rank_col(None, 'popularity_score', 'product_id')} FROM s),
cat AS ({O.CATALOGUE}),
d AS ({O.DETAILS})
SELECT r.rank, r.product_id, {O.DETAIL_LIST}, r.avg_rating, r.rating_count, r.popularity_score
FROM r LEFT JOIN d USING (product_id) WHERE r.rank <= 12
""")
def q_popular_items(spark, sf):
    return popularity.popular_items(T.interactions(spark, sf), T.catalogue(spark, sf), n=12)


# --------------------------------------------------------------------------- R2 + W4

@register("trending_pages", f"""
WITH i AS ({O.INTERACTIONS}),
p AS (SELECT product_id, round(avg(rating) * count(rating), 6) AS popularity_score FROM i
      WHERE product_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY product_id),
r AS (SELECT product_id, popularity_score, {O.rank_col(None, 'popularity_score', 'product_id')} FROM p),
cat AS ({O.CATALOGUE}),
d AS ({O.DETAILS})
SELECT r.rank, CAST(floor((r.rank - 1) / 3) AS INTEGER) AS page_no, r.product_id, {O.DETAIL_LIST},
       r.popularity_score
FROM r JOIN d USING (product_id) WHERE r.rank <= 13
""")
def q_trending_pages(spark, sf):
    """The ids that the labels flag are excluded."""
    pop = popularity.popularity_table(T.interactions(spark, sf))
    flagged = T.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("product_id"))
    return popularity.trending(pop, T.catalogue(spark, sf), n=13, page_size=3, exclude_ids=flagged)


# --------------------------------------------------------------------------- A2

@register("interaction_matrix_long", f"""
WITH i AS ({O.INTERACTIONS})
SELECT user_id, product_id, round(avg(rating), 6) AS rating FROM i GROUP BY user_id, product_id
""")
def q_interaction_matrix_long(spark, sf):
    m = neighbours.rating_matrix(T.interactions(spark, sf))
    return m.select("user_id", "product_id", F.round("rating", 6).alias("rating"))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@register("interaction_matrix_wide", "SELECT user_id, " + ", ".join(
    f"round(coalesce(avg(value) FILTER (WHERE event_type = '{t}'), 0), 6) AS {t}" for t in EVENT_TYPES)
    + " FROM events GROUP BY user_id")
def q_interaction_matrix_wide(spark, sf):
    ev = T.table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("rating"))
    wide = neighbours.wide_matrix(ev, "event_type", EVENT_TYPES)
    return wide.select("user_id", *[F.round(t, 6).alias(t) for t in EVENT_TYPES])


# --------------------------------------------------------------------------- M1 / A13 / F4-F6

PART_DOCS = "SELECT p_partkey AS doc_id, concat_ws(' ', p_name, p_brand, p_type) AS text FROM part"
DOC_DOCS = "SELECT doc_id, text FROM documents"


def _part_model(spark, sf) -> tfidf.TfidfModel:
    return content.fit_catalogue(T.catalogue(spark, sf))


@register("tfidf_weights", f"""
WITH {O.tfidf_ctes(PART_DOCS)}
SELECT doc_id AS product_id, term, round(w, 6) AS weight FROM dv
""")
def q_tfidf_weights(spark, sf):
    m = _part_model(spark, sf)
    return m.weights.select(F.col("doc_id").alias("product_id"), "term", F.round("weight", 6).alias("weight"))


@register("tfidf_documents", f"""
WITH {O.tfidf_ctes(DOC_DOCS)}
SELECT doc_id, term, round(w, 6) AS weight FROM dv
""")
def q_tfidf_documents(spark, sf):
    m = tfidf.fit(T.documents_corpus(spark, sf))
    return m.weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --------------------------------------------------------------------------- R3

PART_QUERIES = "SELECT min(p_partkey) AS request_key, p_name AS query FROM part GROUP BY p_name"


SEARCH_SQL = f"""
WITH {O.tfidf_ctes(PART_DOCS)},
{O.query_vector_ctes(PART_QUERIES, 'idf')},
s AS (SELECT qv.request_key, dv.doc_id AS product_id, sum(qv.w * dv.w) AS s
      FROM qv JOIN dv USING (term) GROUP BY qv.request_key, dv.doc_id),
r AS (SELECT request_key, product_id, round(s, 6) AS score,
             {O.rank_col('request_key', 'round(s, 6)', 'product_id')} FROM s WHERE s > 0),
cat AS ({O.CATALOGUE}),
d AS ({O.DETAILS})
SELECT r.request_key, r.product_id, r.rank, r.score, {O.DETAIL_LIST}
FROM r LEFT JOIN d USING (product_id) WHERE r.rank <= 10
"""


def _product_searches(spark, sf, catalogue, model=None):
    part = T.table(spark, sf, "part")
    queries = part.groupBy("p_name").agg(F.min("p_partkey").alias("request_key")) \
                  .select("request_key", F.col("p_name").alias("query"))
    res = content.search(model or content.fit_catalogue(catalogue), queries, n=10)
    res = res.select("request_key", F.col("doc_id").alias("product_id"), "rank", "score")
    return catalogue_ops.with_details(res, catalogue)


@register("search_products", SEARCH_SQL)
def q_search_products(spark, sf):
    return _product_searches(spark, sf, T.catalogue(spark, sf))


@register("search_repeated_catalogue", SEARCH_SQL)
def q_search_repeated_catalogue(spark, sf):
    """R3 on a catalogue that repeats two thirds of its ids with other texts later on: the first rows count."""
    cat = T.catalogue(spark, sf)
    later = cat.filter("product_id % 3 > 0").withColumns({
        "row_pos": F.col("row_pos") + (1 << 40), "tags": F.concat(F.col("brand"), F.lit(" repeated "), F.col("tags")),
        "name": F.lit("repeated")})
    return _product_searches(spark, sf, cat.unionByName(later))


BENCH_QUERIES = "SELECT item_id AS request_key, text AS query FROM benchmark"


@register("search_documents", f"""
WITH {O.tfidf_ctes(DOC_DOCS)},
{O.query_vector_ctes(BENCH_QUERIES, 'idf')},
s AS (SELECT qv.request_key, dv.doc_id, sum(qv.w * dv.w) AS s
      FROM qv JOIN dv USING (term) GROUP BY qv.request_key, dv.doc_id),
r AS (SELECT request_key, doc_id, round(s, 6) AS score,
             {O.rank_col('request_key', 'round(s, 6)', 'doc_id')} FROM s WHERE s > 0)
SELECT request_key, doc_id, rank, score FROM r WHERE rank <= 10
""")
def q_search_documents(spark, sf):
    model = tfidf.fit(T.documents_corpus(spark, sf))
    queries = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("request_key"),
                                                      F.col("text").alias("query"))
    return content.search(model, queries, n=10).select("request_key", "doc_id", "rank", "score")


# --------------------------------------------------------------------------- R4, A12

@register("similar_products", f"""
WITH {O.tfidf_ctes(PART_DOCS)},
s AS (SELECT a.doc_id AS product_id, b.doc_id AS similar_id, sum(a.w * b.w) AS s
      FROM dv a JOIN dv b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
r AS (SELECT product_id, similar_id, round(s, 6) AS score,
             {O.rank_col('product_id', 'round(s, 6)', 'similar_id')} FROM s WHERE s > 0),
cat AS ({O.CATALOGUE}),
d AS ({O.DETAILS})
SELECT r.product_id, r.similar_id, r.rank, r.score, {O.DETAIL_LIST}
FROM r LEFT JOIN d ON d.product_id = r.similar_id WHERE r.rank <= 16
""")
def q_similar_products(spark, sf):
    model = _part_model(spark, sf)
    requests = T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"))
    return catalogue_ops.with_details(content.similar_items(model, requests, n=16), T.catalogue(spark, sf), "similar_id")


@register("content_centrality", f"""
WITH {O.tfidf_ctes(PART_DOCS)},
c AS (SELECT term, sum(w) / (SELECT n FROM n) AS c FROM dv GROUP BY term)
SELECT doc_id AS product_id, round(sum(w * c), 6) AS centrality FROM dv JOIN c USING (term) GROUP BY doc_id
""")
def q_content_centrality(spark, sf):
    model = _part_model(spark, sf)
    cent = tfidf.centrality(model.weights, T.table(spark, sf, "part"))
    return cent.select(F.col("doc_id").alias("product_id"), F.round("centrality", 6).alias("centrality"))


# --------------------------------------------------------------------------- R5, R6

NAMED_INTERACTIONS = (f"SELECT c_name AS user_id, product_id, rating FROM ({O.INTERACTIONS}) x "
                      "JOIN customer ON c_custkey = x.user_id")


def _user_vectors(interactions_sql: str) -> str:
    return f"""
i AS ({interactions_sql}),
m AS (SELECT user_id, product_id, avg(rating) AS rating FROM i GROUP BY user_id, product_id),
un AS (SELECT user_id, sqrt(sum(rating * rating)) AS norm FROM m GROUP BY user_id),
uv AS (SELECT user_id, product_id, rating / norm AS w FROM m JOIN un USING (user_id) WHERE norm > 0),
us AS (SELECT a.user_id, b.user_id AS neighbour_id, sum(a.w * b.w) AS s
       FROM uv a JOIN uv b USING (product_id) WHERE a.user_id <> b.user_id GROUP BY a.user_id, b.user_id),
nb AS (SELECT * FROM (SELECT user_id, neighbour_id, round(s, 6) AS sim,
             {O.rank_col('user_id', 'round(s, 6)', 'neighbour_id')} FROM us WHERE s > 0) WHERE rank <= 10)"""


USER_VECTORS = _user_vectors(O.INTERACTIONS)


@register("similar_users", f"""
WITH {USER_VECTORS}
SELECT user_id, neighbour_id, rank, sim FROM nb
""")
def q_similar_users(spark, sf):
    m = neighbours.rating_matrix(T.interactions(spark, sf))
    return neighbours.similar_users(m, n=10)


@register("similar_users_by_name", f"""
WITH {_user_vectors(NAMED_INTERACTIONS)}
SELECT user_id, neighbour_id, rank, sim FROM nb
""")
def q_similar_users_by_name(spark, sf):
    """R5 with string user ids (customer names)."""
    names = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    inter = T.interactions(spark, sf).join(names, "user_id").select(F.col("c_name").alias("user_id"), "product_id", "rating")
    return neighbours.similar_users(neighbours.rating_matrix(inter), n=10)


@register("user_based_recs", f"""
WITH {USER_VECTORS},
w AS (SELECT user_id, sum(sim) AS wsum FROM nb GROUP BY user_id),
num AS (SELECT nb.user_id, m.product_id, sum(nb.sim * m.rating) AS num
        FROM nb JOIN m ON m.user_id = nb.neighbour_id GROUP BY nb.user_id, m.product_id),
cand AS (SELECT num.user_id, num.product_id, round(num.num / w.wsum, 6) AS score
         FROM num JOIN w USING (user_id)
         WHERE NOT EXISTS (SELECT 1 FROM m r WHERE r.user_id = num.user_id AND r.product_id = num.product_id
                           AND r.rating > 0)),
r AS (SELECT user_id, product_id, score, {O.rank_col('user_id', 'score', 'product_id')} FROM cand),
cat AS ({O.CATALOGUE}),
d AS ({O.DETAILS})
SELECT r.user_id, r.product_id, r.rank, r.score, {O.DETAIL_LIST}
FROM r LEFT JOIN d USING (product_id) WHERE r.rank <= 10
""")
def q_user_based_recs(spark, sf):
    m = written(neighbours.rating_matrix(T.interactions(spark, sf)))  # read by three branches
    nb = neighbours.similar_users(m, n=10)
    return catalogue_ops.with_details(neighbours.user_based(m, nb, n=10), T.catalogue(spark, sf))


# --------------------------------------------------------------------------- F7/F8 dense

@register("dense_cosine_neighbours", """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nv AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
s AS (SELECT a.id AS vec_id, b.id AS neighbour_id, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS s
      FROM nv a JOIN nv b ON a.id <> b.id WHERE a.norm > 0 AND b.norm > 0),
r AS (SELECT vec_id, neighbour_id, round(s, 6) AS score,
             CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, neighbour_id) AS INTEGER) AS rank
      FROM s)
SELECT vec_id, neighbour_id, rank, score FROM r WHERE rank <= 10
""")
def q_dense_cosine_neighbours(spark, sf):
    vec = T.dense_vectors(spark, sf)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = (vec.withColumn("norm", norm).filter(F.col("norm") > 0)
            .select("id", F.transform("vec", lambda x: x / F.col("norm")).alias("vec")))
    res = dense_top_n(unit, unit, 10, exclude_self=True)
    return res.select(F.col("lid").alias("vec_id"), F.col("rid").alias("neighbour_id"), "rank", "score")


# --------------------------------------------------------------------------- A3-A7 profiles

def _events_with_nulls(spark, sf):
    """events with nulls made from the data: error events lose their type,
    signup events lose their value."""
    ev = T.table(spark, sf, "events")
    return ev.select("event_id", "ts", "user_id",
                     F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
                     F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
                     "props")


EVENTS_NULLS_SQL = ("SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type, "
                    "CASE WHEN event_type <> 'signup' THEN value END AS value, props FROM events")
EVENT_COLS = (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
              ("value", "double"), ("props", "string"))


@register("null_profile", f"""
WITH e AS ({EVENTS_NULLS_SQL})
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count({c}) AS non_null_count, "
    f"count(*) - count({c}) AS null_count FROM e" for c, t in EVENT_COLS))
def q_null_profile(spark, sf):
    return profile.null_profile(_events_with_nulls(spark, sf))


STRING_COLS = ("o_orderstatus", "o_orderpriority")


@register("distinct_profile", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in STRING_COLS) + """),
c AS (SELECT column_name, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY column_name, value)
SELECT column_name, CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM c GROUP BY column_name
""")
def q_distinct_profile(spark, sf):
    return profile.string_summary(T.table(spark, sf, "orders"), STRING_COLS)


NUMERIC_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("column_summary", "WITH l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in NUMERIC_COLS) + """)
SELECT column_name, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, max(value) AS max,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75
FROM l GROUP BY column_name
""")
def q_column_summary(spark, sf):
    return profile.numeric_summary(T.table(spark, sf, "lineitem"), NUMERIC_COLS)


# --------------------------------------------------------------------------- P9, P10

@register("fill_constant", f"""
WITH e AS ({EVENTS_NULLS_SQL})
SELECT event_id, coalesce(event_type, '') AS event_type, value FROM e
""")
def q_fill_constant(spark, sf):
    ev = _events_with_nulls(spark, sf).select("event_id", "event_type", "value")
    return cleaning.fill_constant(ev, "", ["event_type"])


@register("impute_mean", f"""
WITH e AS ({EVENTS_NULLS_SQL})
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value FROM e
""")
def q_impute_mean(spark, sf):
    ev = _events_with_nulls(spark, sf).select("event_id", "value")
    out = cleaning.impute_mean(ev, ["value"])
    return out.select("event_id", F.round("value", 6).alias("value"))


# --------------------------------------------------------------------------- W1, W2

@register("group_first", f"""
WITH e AS ({EVENTS_NULLS_SQL}),
f AS (SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS first_type
      FROM e WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT e.event_id, e.user_id, f.first_type AS event_type FROM e LEFT JOIN f USING (user_id)
""")
def q_group_first(spark, sf):
    ev = _events_with_nulls(spark, sf).select("event_id", "user_id", "event_type")
    return cleaning.group_first(ev, "user_id", ["event_type"], order_col="event_id")


@register("group_ffill_bfill", f"""
WITH e AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id,
       coalesce(last_value(event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS event_type,
       coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM e
""")
def q_group_ffill_bfill(spark, sf):
    ev = _events_with_nulls(spark, sf).select("event_id", "user_id", "event_type", "value")
    return cleaning.group_ffill_bfill(ev, "user_id", ["event_type", "value"], order_col="event_id")


# --------------------------------------------------------------------------- F1, F2

@register("category_head", """
SELECT p_partkey AS product_id, split_part(p_type || ' > ' || p_brand, '>', 1) AS category FROM part
""")
def q_category_head(spark, sf):
    part = T.table(spark, sf, "part")
    path = F.concat(F.col("p_type"), F.lit(" > "), F.col("p_brand"))
    return part.select(F.col("p_partkey").alias("product_id"), tx.first_segment(path).alias("category"))


@register("truncate_name", """
SELECT doc_id,
       CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS snippet,
       CASE WHEN length(source) > 3 THEN substring(source, 1, 3) || '...' ELSE source END AS source_short
FROM documents
""")
def q_truncate_name(spark, sf):
    docs = T.table(spark, sf, "documents")
    return docs.select("doc_id", tx.truncate("text", 100).alias("snippet"), tx.truncate("source", 3).alias("source_short"))


# --------------------------------------------------------------------------- A9, A8

@register("dedup_first", """
SELECT doc_id, lang, source, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)
""")
def q_dedup_first(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("text_key"), "doc_id", "lang", "source", "n_chars")
    kept = catalogue_ops.dedup_first(docs, "text_key", order_col="doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars")


@register("distinct_first_seen", """
SELECT lang, min(doc_id) AS first_pos,
       CAST(row_number() OVER (ORDER BY min(doc_id), lang) AS BIGINT) AS seen_order
FROM documents WHERE lang IS NOT NULL GROUP BY lang
""")
def q_distinct_first_seen(spark, sf):
    docs = T.table(spark, sf, "documents")
    return catalogue_ops.distinct_first_seen(docs, "lang", order_col="doc_id")


# --------------------------------------------------------------------------- M5, J2, P14, J10

@register("id_index", """
SELECT c_name AS id, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS idx FROM customer
""")
def q_id_index(spark, sf):
    return lookup.id_index(T.table(spark, sf, "customer").select(F.col("c_name").alias("id")))


@register("unknown_users", """
SELECT DISTINCT c_custkey AS user_id FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)
""")
def q_unknown_users(spark, sf):
    requests = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    known = T.table(spark, sf, "events").select("user_id")
    return lookup.unknown_ids(requests, known, "user_id")


@register("missing_products", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def q_missing_products(spark, sf):
    """Ids of one table that another one lacks (documents without a label)."""
    return lookup.missing_ids(T.table(spark, sf, "documents").select("doc_id"), T.table(spark, sf, "labels"), "doc_id")


@register("recs_unknown_users", """
SELECT user_id FROM (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM events) r
WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)
""")
def q_recs_unknown_users(spark, sf):
    """P14 for R8 and R10: requested users that a fitted model (of the event values) does not hold, so they get no list."""
    customer = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    events = T.table(spark, sf, "events")
    requests = customer.unionByName(events.select("user_id")).filter("user_id IS NOT NULL")
    m = neighbours.rating_matrix(events.select("user_id", F.col("event_type").alias("product_id"), F.col("value").alias("rating")))
    f = factors.truncated_svd(m.filter("user_id IS NOT NULL").checkpoint(), k=2)
    return factors.unknown_users(f, requests)


@register("recs_missing_products", f"""
WITH i AS ({O.INTERACTIONS}),
p AS (SELECT product_id, round(avg(rating) * count(rating), 6) AS s FROM i GROUP BY product_id),
r AS (SELECT product_id, {O.rank_col(None, 's', 'product_id')} FROM p)
SELECT product_id FROM r WHERE product_id NOT IN (SELECT doc_id FROM documents)
""")
def q_recs_missing_products(spark, sf):
    """J10 for R8 and R10: recommended ids (here the whole popularity ranking) without a row in a catalogue
    (here the documents, which hold other ids as well)."""
    scored = popularity.popularity_table(T.interactions(spark, sf))
    return lookup.missing_ids(scored.select("product_id"), T.table(spark, sf, "documents").select(
        F.col("doc_id").alias("product_id")), "product_id")


@register("point_lookup", """
SELECT p_partkey AS product_id, p_partkey AS row_pos FROM part WHERE p_partkey IN (SELECT doc_id FROM documents)
""")
def q_point_lookup(spark, sf):
    """P5: first catalogue position of each requested product (the ids of the documents; unknown ones give no row)."""
    wanted = T.table(spark, sf, "documents").select(F.col("doc_id").alias("product_id"))
    return catalogue_ops.point_lookup(T.catalogue(spark, sf), "product_id", wanted)


@register("fetch_by_position", f"""
WITH i AS ({O.INTERACTIONS}),
p AS (SELECT product_id, count(rating) AS c FROM i GROUP BY product_id)
SELECT p.product_id AS row_pos, p.c AS n_ratings, c.name, c.brand FROM p JOIN ({O.CATALOGUE}) c ON c.row_pos = p.product_id
""")
def q_fetch_by_position(spark, sf):
    """Catalogue rows at given positions (here every rated product's)."""
    positions = T.interactions(spark, sf).groupBy(F.col("product_id").alias("row_pos")).agg(
        F.count("rating").alias("n_ratings"))
    return catalogue_ops.fetch_by_position(T.catalogue(spark, sf), positions).select("row_pos", "n_ratings", "name", "brand")


@register("encode_decode", """
WITH m AS (SELECT c_name, c_custkey, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS idx FROM customer)
SELECT o_orderkey, m.idx, m.c_name AS user_name FROM orders JOIN m ON m.c_custkey = o_custkey
""")
def q_encode_decode(spark, sf):
    """User names to indexes and back."""
    names = T.table(spark, sf, "customer").select("c_custkey", "c_name")
    mapping = lookup.id_index(names.select(F.col("c_name").alias("id"))).checkpoint()
    rows = T.table(spark, sf, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    coded = lookup.encode(rows, "c_name", mapping).select("o_orderkey", "idx")
    return lookup.decode(coded, "idx", mapping, "user_name").select("o_orderkey", "idx", "user_name")


# --------------------------------------------------------------------------- G1-G7

def _u32(expr: str) -> str:  # 60-bit md5 draw in SQL
    return O.md5_draw(expr)


@register("sample_exact", f"""
SELECT p_partkey AS product_id, p_name AS name FROM part
ORDER BY {_u32("CAST(p_partkey AS VARCHAR) || '|42'")}, p_partkey LIMIT 500
""")
def q_sample_exact(spark, sf):
    cat = T.catalogue(spark, sf).select("product_id", "name")
    return sampling.sample_exact(cat, 500, "product_id", seed=42)


@register("sample_fraction", f"""
SELECT user_id, product_id, rating FROM ({O.INTERACTIONS}) i
WHERE {_u32("CAST(user_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) || '|42'")} < {int(0.05 * (1 << 60))}
""")
def q_sample_fraction(spark, sf):
    inter = T.interactions(spark, sf).withColumn("pair", F.concat_ws("|", F.col("user_id").cast("string"),
                                                                      F.col("product_id").cast("string")))
    return sampling.sample_fraction(inter, 0.05, "pair", seed=42).drop("pair")


@register("sample_replace", f"""
WITH c AS (SELECT p_partkey AS product_id, p_name AS name,
                  row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
d AS (SELECT range AS draw_no, {_u32("CAST(range AS VARCHAR) || '|42'")} % (SELECT count(*) FROM c) AS pos
      FROM range(6000))
SELECT d.draw_no, c.product_id, c.name FROM d JOIN c USING (pos)
""")
def q_sample_replace(spark, sf):
    cat = T.catalogue(spark, sf).select("product_id", "name", "row_pos")
    out = sampling.sample_with_replacement(cat, 6000, "row_pos", seed=42)
    return out.select("draw_no", "product_id", "name")


@register("random_assign", f"""
WITH dom AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS pos FROM (SELECT DISTINCT c_name FROM customer)),
o AS (SELECT o_orderkey, {_u32("CAST(o_orderkey AS VARCHAR) || '|assign|42'")} % (SELECT count(*) FROM dom) AS pos
      FROM orders)
SELECT o.o_orderkey, dom.c_name AS user_name,
       CAST(0 + {_u32("CAST(o_orderkey AS VARCHAR) || '|rating|42'")} % 5 AS INTEGER) AS rating
FROM o JOIN dom USING (pos)
""")
def q_random_assign(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey")
    dom = T.table(spark, sf, "customer").select(F.col("c_name"))
    out = sampling.assign_from_domain(orders, dom, "o_orderkey", "c_name", seed=42)
    from ..functions.hashing import randint
    return out.select("o_orderkey", F.col("c_name").alias("user_name"),
                      randint(0, 5, "o_orderkey", F.lit("rating"), seed=42).alias("rating"))


def _draws_sql(users_sql: str, k: int, n_draws: int) -> str:
    return f"""
items AS (SELECT p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
u AS ({users_sql}),
d AS (SELECT u.user_id, j.range AS j,
             {_u32("CAST(u.user_id AS VARCHAR) || '|' || CAST(j.range AS VARCHAR) || '|42'")}
               % (SELECT count(*) FROM items) AS pos
      FROM u, range({n_draws}) j),
f AS (SELECT user_id, pos, min(j) AS j FROM d GROUP BY user_id, pos),
r AS (SELECT user_id, pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY j) AS INTEGER) AS rank FROM f),
picked AS (SELECT r.user_id, items.product_id, r.rank FROM r JOIN items USING (pos) WHERE r.rank <= {k})"""


@register("synthetic_interactions", "WITH " + _draws_sql("SELECT DISTINCT c_custkey AS user_id FROM customer", 50, 100) + f"""
SELECT user_id, product_id,
       CAST(1 + {_u32("CAST(user_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) || '|rating|42'")} % 5 AS INTEGER)
         AS rating
FROM picked
""")
def q_synthetic_interactions(spark, sf):
    users = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    items = T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"))
    picks = sampling.distinct_draws(users, "user_id", items, "product_id", 50, seed=42)
    return sampling.synthetic_ratings(picks, "user_id", "product_id", 1, 6, seed=42).drop("rank")


@register("user_random_list", "WITH " + _draws_sql("SELECT DISTINCT c_custkey AS user_id FROM customer", 12, 24) + """
SELECT user_id, product_id, rank FROM picked
""")
def q_user_random_list(spark, sf):
    users = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    items = T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"))
    return sampling.distinct_draws(users, "user_id", items, "product_id", 12, seed=42)


# --------------------------------------------------------------------------- M3/M4, R7, R8, R9 (no SQL)

#: Paths of the models fitted for a table in this application, so queries on one model fit it once.
_FITTED: dict[tuple, str] = {}


def _fitted(spark, sf, name, matrix, k):
    """The rank-``k`` model of a matrix: fitted and saved by the first query that needs it, then loaded."""
    key = (spark.sparkContext.applicationId, sf, name, k)
    if key not in _FITTED:
        path = f"{ensure_checkpoint_dir(spark)}/svd-model-{uuid.uuid4().hex}"
        factors.save(factors.truncated_svd(matrix, k=k, seed=42), path)
        _FITTED[key] = path
    return factors.load(spark, _FITTED[key])


def _svd(spark, sf, k):
    m = neighbours.rating_matrix(T.interactions(spark, sf)).checkpoint()  # read by the fit and the exclusions
    return m, _fitted(spark, sf, "ratings", m, k)


@register("svd_recs")
def q_svd_recs(spark, sf):
    """Rank-50 factor scores, unrated items only, top 15 per user, with details."""
    m, f = _svd(spark, sf, 50)
    return catalogue_ops.with_details(factors.recommend(f, m, 15, exclude_rated=True), T.catalogue(spark, sf))


@register("svd_recs_with_rating")
def q_svd_recs_with_rating(spark, sf):
    """Rank-5 factor scores over all items (rated included), top 12 per
    user with the predicted rating and catalogue details."""
    m, f = _svd(spark, sf, 5)
    recs = factors.recommend(f, m, 12, exclude_rated=False).withColumnRenamed("score", "predicted_rating")
    return catalogue_ops.with_details(recs, T.catalogue(spark, sf))


def _brand_matrix(spark, sf):
    """Mean quantity by user and brand: many pairs never occur."""
    brands = T.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), "p_brand")
    rows = T.interactions(spark, sf).join(brands, "product_id").select("user_id", F.col("p_brand").alias("product_id"), "rating")
    return neighbours.rating_matrix(rows).checkpoint()


BRAND_MATRIX_SQL = f"""
i AS ({O.INTERACTIONS}),
m AS (SELECT user_id, p_brand AS product_id, avg(rating) AS rating FROM i JOIN part ON p_partkey = product_id
      GROUP BY user_id, p_brand),
g AS (SELECT u.user_id, t.product_id, coalesce(m.rating, 0) AS rating, m.rating IS NOT NULL AND m.rating > 0 AS rated
      FROM (SELECT DISTINCT user_id FROM m) u CROSS JOIN (SELECT DISTINCT product_id FROM m) t
      LEFT JOIN m USING (user_id, product_id))"""


@register("svd_recs_with_rating_full_rank", f"""
WITH {BRAND_MATRIX_SQL},
r AS (SELECT user_id, product_id, round(rating, 6) AS predicted_rating,
             {O.rank_col('user_id', 'round(rating, 6)', 'product_id')} FROM g)
SELECT user_id, product_id, rank, predicted_rating FROM r WHERE rank <= 12
""")
def q_svd_full_rank(spark, sf):
    """R8 at full rank on the user x brand matrix: a prediction is the mean value itself (0 where missing)."""
    m = _brand_matrix(spark, sf)
    f = _fitted(spark, sf, "brands", m, 64)
    return factors.recommend(f, m, 12, exclude_rated=False).withColumnRenamed("score", "predicted_rating")


@register("svd_recs_full_rank", f"""
WITH {BRAND_MATRIX_SQL},
r AS (SELECT user_id, product_id, CAST(0 AS DOUBLE) AS score, {O.rank_col('user_id', 'rating', 'product_id')}
      FROM g WHERE NOT rated)
SELECT user_id, product_id, rank, score FROM r WHERE rank <= 12
""")
def q_svd_unrated_full_rank(spark, sf):
    """R7 at full rank on the same matrix: only the unrated brands remain, and they are predicted 0."""
    m = _brand_matrix(spark, sf)
    return factors.recommend(_fitted(spark, sf, "brands", m, 64), m, 12, exclude_rated=True)


BRAND_DOCS = "SELECT p_brand AS doc_id, string_agg(p_name || ' ' || p_type, ' ') AS text FROM part GROUP BY p_brand"


@register("hybrid_recs_full_rank", f"""
WITH {BRAND_MATRIX_SQL},
{O.tfidf_ctes(BRAND_DOCS, 'b')},
c AS (SELECT term, sum(w) / (SELECT n FROM bn) AS c FROM bdv GROUP BY term),
bias AS (SELECT doc_id AS product_id, sum(w * c) AS bias FROM bdv JOIN c USING (term) GROUP BY doc_id),
s AS (SELECT user_id, product_id, round(coalesce(bias, 0), 6) AS score FROM g LEFT JOIN bias USING (product_id) WHERE NOT rated),
r AS (SELECT *, {O.rank_col('user_id', 'score', 'product_id')} FROM s)
SELECT user_id, product_id, rank, score FROM r WHERE rank <= 10
""")
def q_hybrid_full_rank(spark, sf):
    """R9 at full rank on the same matrix: an unrated brand scores 0 plus the mean similarity of its words to all brands."""
    m = _brand_matrix(spark, sf)
    part = T.table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    model = tfidf.fit(part)
    bias = tfidf.centrality(model.weights, part.select("doc_id").distinct()).select(
        F.col("doc_id").alias("product_id"), F.col("centrality").alias("bias"))
    return factors.recommend(_fitted(spark, sf, "brands", m, 64), m, 10, exclude_rated=True, item_bias=bias)


@register("hybrid_recs")
def q_hybrid_recs(spark, sf):
    """Rank-50 factor score + mean content similarity of the item to the
    catalogue, unrated items only, top 10 per user, with details."""
    m, f = _svd(spark, sf, 50)
    model = _part_model(spark, sf)
    cent = tfidf.centrality(model.weights, T.table(spark, sf, "part")).select(
        F.col("doc_id").alias("product_id"), F.col("centrality").alias("bias"))
    recs = factors.recommend(f, m, 10, exclude_rated=True, item_bias=cent)
    return catalogue_ops.with_details(recs, T.catalogue(spark, sf))


@register("als_recs")
def q_als_recs(spark, sf):
    """ALS (rank 10) predicted ratings over all items, top 10 per user, with details."""
    m = neighbours.rating_matrix(T.interactions(spark, sf))
    f = als.fit(m, rank=10, max_iter=10, reg=0.1, seed=42)
    return catalogue_ops.with_details(als.recommend(f, n=10), T.catalogue(spark, sf))


# --------------------------------------------------------------------------- R11, R12

@register("home_lists", "WITH " + _draws_sql("SELECT c_custkey AS user_id FROM customer", 12, 24) + """,
unknown AS (SELECT p_partkey AS user_id FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)),
head AS (SELECT p_partkey AS product_id, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS rank
         FROM part ORDER BY p_partkey LIMIT 12),
i AS (SELECT user_id, product_id, round(avg(rating), 6) AS score FROM (""" + O.INTERACTIONS + """) x
      WHERE user_id IN (SELECT user_id FROM events) GROUP BY user_id, product_id),
best AS (SELECT user_id, product_id, """ + O.rank_col("user_id", "score", "product_id") + """ FROM i),
lists AS (SELECT * FROM best WHERE rank <= 12)
SELECT user_id, 'personal' AS source, rank, product_id FROM lists
UNION ALL
SELECT user_id, 'random' AS source, rank, product_id FROM picked WHERE user_id NOT IN (SELECT user_id FROM lists)
UNION ALL
SELECT unknown.user_id, 'default' AS source, head.rank, head.product_id FROM unknown, head
""")
def q_home_lists(spark, sf):
    """Users with events have ranked lists, other customers random ones, and ids of no customer the default."""
    known = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    requests = known.unionByName(T.table(spark, sf, "part").select(F.col("p_partkey").alias("user_id")))
    active = T.table(spark, sf, "events").select("user_id").distinct()
    m = neighbours.rating_matrix(T.interactions(spark, sf)).join(active, "user_id", "left_semi")
    ranked = top_n_per_group(m.withColumn("rating", half_up("rating")), "user_id", "rating", "product_id", 12)
    return serving.home_lists(requests, known, T.catalogue(spark, sf), n=12, seed=42, ranked=ranked)


def _raw_marketplace(spark, sf):
    """part as a raw marketplace table (raw column names, path-like category) in which
    three rows share an id, some ids are missing and many details are null."""
    part = T.table(spark, sf, "part")
    key = F.col("p_partkey")
    return part.select(
        key.alias("row_pos"),
        F.when(key % 97 > 0, F.floor(key / 3).cast("string")).alias("Product Id"),
        F.concat(F.col("p_type"), F.lit(" > "), F.col("p_brand")).alias("Product Category"),
        F.when(key % 4 > 0, F.col("p_brand")).alias("Product Brand"),
        F.when(key % 5 > 1, F.col("p_name")).alias("Product Name"),
        F.when(key % 2 > 0, F.concat(F.lit("img/"), key.cast("string"))).alias("Product Image Url"),
        F.when(key % 7 > 2, F.col("p_name")).alias("Product Description"),
        F.when(key % 3 > 0, F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("Product Tags"),
    )


PREP_DETAILS = ("Category", "Brand", "Name", "ImageURL", "Description", "Tags")


@register("prep_pipeline", f"""
WITH raw AS (SELECT p_partkey AS row_pos,
                    CASE WHEN p_partkey % 97 > 0 THEN CAST(p_partkey // 3 AS VARCHAR) END AS ProdID,
                    p_type || ' > ' || p_brand AS Category,
                    coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_brand END, '') AS Brand,
                    CASE WHEN p_partkey % 5 > 1 THEN p_name END AS Name,
                    CASE WHEN p_partkey % 2 > 0 THEN 'img/' || CAST(p_partkey AS VARCHAR) END AS ImageURL,
                    coalesce(CASE WHEN p_partkey % 7 > 2 THEN p_name END, '') AS Description,
                    CASE WHEN p_partkey % 3 > 0 THEN concat_ws(' ', p_name, p_brand, p_type) END AS Tags FROM part),
s AS (SELECT * FROM raw ORDER BY {_u32("CAST(row_pos AS VARCHAR) || '|42'")}, row_pos LIMIT 1500),
w1 AS (SELECT row_pos, ProdID, """ + ", ".join(
    f"CASE WHEN ProdID IS NOT NULL THEN first_value({c} IGNORE NULLS) OVER (PARTITION BY ProdID ORDER BY row_pos "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS {c}" for c in PREP_DETAILS) + """ FROM s),
w2 AS (SELECT row_pos, ProdID, """ + ", ".join(
    f"CASE WHEN ProdID IS NOT NULL THEN coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ProdID ORDER BY row_pos "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY ProdID "
    f"ORDER BY row_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {c}" for c in PREP_DETAILS) + f""" FROM w1),
c AS (SELECT *, row_number() OVER (ORDER BY row_pos) - 1 AS pos FROM w2),
d AS (SELECT range AS draw_no, {_u32("CAST(range AS VARCHAR) || '|42'")} % (SELECT count(*) FROM c) AS pos
      FROM range(6000)),
dom AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS upos
        FROM (SELECT 'USER_' || CAST(range AS VARCHAR) AS user_id FROM range(1, 1401)))
SELECT d.draw_no, c.ProdID, split_part(c.Category, '>', 1) AS Category, c.Brand, c.Name, c.ImageURL,
       c.Description, c.Tags, dom.user_id,
       CAST({_u32("CAST(d.draw_no AS VARCHAR) || '|rating|42'")} % 5 AS INTEGER) AS Rating
FROM d JOIN c USING (pos)
JOIN dom ON dom.upos = {_u32("CAST(d.draw_no AS VARCHAR) || '|assign|42'")} % 1400
""")
def q_prep_pipeline(spark, sf):
    domain = sampling.generated_ids(spark, "USER_", 1, 1401, "user_id")
    return serving.prepare_catalogue(_raw_marketplace(spark, sf), domain, 1500, 6000, seed=42)


# --------------------------------------------------------------------------- P14/J10 on raw ids, P15

@register("unknown_ids", """
SELECT user_id FROM (SELECT o_custkey AS user_id FROM orders UNION SELECT user_id FROM events) r
WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer)
""")
def q_unknown_ids(spark, sf):
    """Customer keys referenced by orders or events without a customer row."""
    requests = (T.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
                .unionByName(T.table(spark, sf, "events").select("user_id"))
                .filter(F.col("user_id").isNotNull()))
    known = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return lookup.unknown_ids(requests, known, "user_id")


SEARCH_LOG = (PART_QUERIES + " UNION ALL SELECT -1 - item_id AS request_key, text AS query FROM benchmark")


@register("search_no_results", f"""
WITH {O.tfidf_ctes(PART_DOCS)},
{O.query_vector_ctes(SEARCH_LOG, 'idf')}
SELECT request_key FROM qs
WHERE request_key NOT IN (SELECT DISTINCT qv.request_key FROM qv JOIN dv USING (term) WHERE qv.w * dv.w > 0)
""")
def q_search_no_results(spark, sf):
    """Requests of a search log (product-name searches and benchmark
    passages) that get no result from the product catalogue -- the "no
    recommendations" branch, in batch form."""
    model = _part_model(spark, sf)
    part = T.table(spark, sf, "part")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("request_key")) \
                .select("request_key", F.col("p_name").alias("query"))
    passages = T.table(spark, sf, "benchmark").select((F.lit(-1) - F.col("item_id")).alias("request_key"),
                                                       F.col("text").alias("query"))
    log = names.unionByName(passages)
    return content.without_results(model, log)


# --------------------------------------------------------------------------- S1/S2 damaged files, S5, A3 over parts

def _damaged_lines(spark, sf):
    """part as delimited lines, some of them short, long, with a broken quote or with a word for a number."""
    key = F.col("p_partkey")
    fields = [key.cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), F.col("p_brand"), F.col("p_size").cast("string")]
    line = (F.when(key % 50 == 1, F.concat_ws(",", *fields[:2])).when(key % 50 == 2, F.concat_ws(",", *fields, F.lit("more")))
            .when(key % 50 == 3, F.concat_ws(",", fields[0], F.concat(F.lit('"'), "p_name"), *fields[2:]))
            .when(key % 50 == 4, F.concat_ws(",", *fields[:3], F.lit("large"))).otherwise(F.concat_ws(",", *fields)))
    return T.table(spark, sf, "part").select(line.alias("value"))


@register("ingest_damaged", """
SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_size AS size, CAST(NULL AS VARCHAR) AS record
FROM part WHERE p_partkey % 50 NOT IN (1, 2, 3, 4)
UNION ALL
SELECT NULL, NULL, NULL, NULL, CASE p_partkey % 50
         WHEN 1 THEN concat_ws(',', p_partkey, '"' || p_name || '"')
         WHEN 2 THEN concat_ws(',', p_partkey, '"' || p_name || '"', p_brand, p_size, 'more')
         WHEN 3 THEN concat_ws(',', p_partkey, '"' || p_name, p_brand, p_size)
         ELSE concat_ws(',', p_partkey, '"' || p_name || '"', p_brand, 'large') END
FROM part WHERE p_partkey % 50 IN (1, 2, 3, 4)
""")
def q_ingest_damaged(spark, sf):
    """The whole catalogue written as lines, some damaged, and read back: clean rows, and records in quarantine."""
    folder = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    _damaged_lines(spark, sf).write.text(f"{folder}/raw")
    clean, bad = files.ingest_delimited(spark, f"{folder}/raw", "product_id bigint, name string, brand string, size int",
                                        f"{folder}/staged", header=False)
    return clean.withColumn("record", F.lit(None).cast("string")).unionByName(bad.select("record"), allowMissingColumns=True)


@register("search_saved_model", ORACLE["search_products"])
def q_search_saved_model(spark, sf):
    """The fitted TF-IDF is saved as a version, loaded, and searched."""
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    tfidf.save(_part_model(spark, sf), path)
    return _product_searches(spark, sf, T.catalogue(spark, sf), tfidf.load(spark, path))


@register("distinct_over_parts", """
SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS exact, TRUE AS inside_error FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey), TRUE FROM lineitem
UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), TRUE FROM lineitem
""")
def q_distinct_over_parts(spark, sf):
    """A3: distinct sketches stored per part (return flag), united on read, next to the exact counts."""
    cols = ["l_partkey", "l_suppkey", "l_orderkey"]
    items = T.table(spark, sf, "lineitem")
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    profile.distinct_sketches(items, "l_returnflag", cols).write.partitionBy("part").parquet(path)
    estimates = profile.distinct_estimates(spark.read.parquet(path))
    exact = items.agg(*(F.count_distinct(c).alias(c) for c in cols)).unpivot([], cols, "column_name", "exact")
    return exact.join(estimates, "column_name").select("column_name", "exact", (
        F.abs(F.col("estimate") - F.col("exact")) <= profile.SKETCH_ERROR * F.col("exact")).alias("inside_error"))
