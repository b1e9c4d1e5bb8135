"""SQL text fragments for the DuckDB oracle (same semantics as the Spark plans).

Kept beside the Spark code so both sides use one set of fixed values (token
pattern, stop words, rounding).
"""

from __future__ import annotations

from ..functions.text import STOP_WORDS, TOKEN_PATTERN

INTERACTIONS = (
    "SELECT o.o_custkey AS user_id, l.l_partkey AS product_id, l.l_quantity AS rating "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
)

CATALOGUE = (
    "SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, "
    "'img/' || CAST(p_partkey AS VARCHAR) AS image_url, "
    "concat_ws(' ', p_name, p_brand, p_type) AS tags, p_partkey AS row_pos FROM part"
)

DETAILS = (
    "SELECT product_id, "
    "arg_min(name, row_pos) FILTER (WHERE name IS NOT NULL) AS name, "
    "arg_min(brand, row_pos) FILTER (WHERE brand IS NOT NULL) AS brand, "
    "arg_min(category, row_pos) FILTER (WHERE category IS NOT NULL) AS category, "
    "arg_min(image_url, row_pos) FILTER (WHERE image_url IS NOT NULL) AS image_url "
    "FROM cat GROUP BY product_id"
)


#: The columns that a ranked list takes from ``d``.
DETAIL_LIST = "d.name, d.brand, d.category, d.image_url"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


STOP_LIST = sql_list(STOP_WORDS)


def tokens(expr: str) -> str:
    return f"unnest(regexp_extract_all(lower({expr}), '{TOKEN_PATTERN}'))"


def tfidf_ctes(docs_sql: str, prefix: str = "") -> str:
    """CTEs ``{p}docs, {p}tf, {p}idf, {p}dv(doc_id, term, w)`` -- unrounded unit weights."""
    p = prefix
    return f"""
{p}docs AS ({docs_sql}),
{p}tok AS (SELECT doc_id, {tokens('text')} AS term FROM {p}docs),
{p}tf AS (SELECT doc_id, term, count(*) AS tf FROM {p}tok WHERE term NOT IN ({STOP_LIST}) GROUP BY doc_id, term),
{p}n AS (SELECT count(*) AS n FROM {p}docs),
{p}idf AS (SELECT term, ln(CAST(1 + (SELECT n FROM {p}n) AS DOUBLE) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
           FROM {p}tf GROUP BY term),
{p}raw AS (SELECT doc_id, term, tf * idf AS w FROM {p}tf JOIN {p}idf USING (term)),
{p}nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM {p}raw GROUP BY doc_id),
{p}dv AS (SELECT doc_id, term, w / norm AS w FROM {p}raw JOIN {p}nrm USING (doc_id) WHERE norm > 0)"""


def query_vector_ctes(queries_sql: str, idf_cte: str, prefix: str = "q") -> str:
    """CTEs ``{p}v(request_key, term, w)``: queries vectorised with a fitted idf."""
    p = prefix
    return f"""
{p}s AS ({queries_sql}),
{p}tok AS (SELECT request_key, {tokens('query')} AS term FROM {p}s),
{p}tf AS (SELECT request_key, term, count(*) AS tf FROM {p}tok WHERE term NOT IN ({STOP_LIST}) GROUP BY request_key, term),
{p}raw AS (SELECT request_key, term, tf * idf AS w FROM {p}tf JOIN {idf_cte} USING (term)),
{p}nrm AS (SELECT request_key, sqrt(sum(w * w)) AS norm FROM {p}raw GROUP BY request_key),
{p}v AS (SELECT request_key, term, w / norm AS w FROM {p}raw JOIN {p}nrm USING (request_key) WHERE norm > 0)"""


def rank_col(partition: str | None, score: str, id_col: str, alias: str = "rank") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return f"CAST(row_number() OVER ({part}ORDER BY {score} DESC NULLS LAST, {id_col}) AS INTEGER) AS {alias}"


def md5_draw(expr: str) -> str:
    """First 15 hex digits of md5 as an integer (same as ``hashing.md5_draw``)."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 15)) AS BIGINT)"
