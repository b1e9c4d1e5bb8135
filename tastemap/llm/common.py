"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.session import ensure_checkpoint_dir, ship_package

#: A row-id list is broadcast only up to this many rows (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


#: Rows in an Arrow batch where the session has Spark's default; whole texts travel, so fewer.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, package on the workers, short Arrow batches; cheap when already done."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark writes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read from there.

    This cuts the lineage as ``checkpoint()`` does, and the planner's size of the frame as well, which is then that
    of its files.  A checkpointed frame keeps the size estimated for its plan, and a join multiplies the sizes of its
    sides: where a loop joins its last state, the digits of the estimate would multiply in every round.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plan nodes that keep each row of a file scan as one row.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias"}


def _is_one_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is one file scan with filters and projections at most."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROW_BY_ROW:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def with_row_id(docs: DataFrame, row_id: str = "_tm_row") -> DataFrame:
    """``docs`` with a long that stays with its row, whichever job reads it and however the files are split.

    In a scan of Parquet files it is the number of the file (in the order of
    the paths, which Spark's driver lists anyway) and the place of the row in
    the file.  Any other frame is numbered once and written into the checkpoint
    folder, and later plans read it from there.  Ids of the data are not used
    as row ids because they may be null or repeated.
    """
    if _is_one_scan(docs):
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("_tm_path"), F.col("_metadata.row_index").alias("_tm_index"))
        except AnalysisException:  # a format without row places
            placed = None
        if placed is not None:
            # one row a file, read from the footers: bounded by the listing that the driver holds for the scan
            files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
            if len(files) <= 1:
                return placed.withColumn(row_id, F.col("_tm_index")).drop("_tm_path", "_tm_index")
            numbers = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "_tm_path string, _tm_file long")
            return (placed.join(F.broadcast(numbers), "_tm_path")
                    .withColumn(row_id, F.col("_tm_file") * (1 << 40) + F.col("_tm_index"))
                    .drop("_tm_path", "_tm_file", "_tm_index"))
    return docs.withColumn(row_id, F.monotonically_increasing_id()).checkpoint()


def fresh_name(docs: DataFrame, stem: str = "_tm_row") -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def keyed(docs: DataFrame, *columns: Column) -> tuple[DataFrame, DataFrame, str]:
    """``(numbered, narrow, name)``: ``docs`` with a row id under a name that it does not have, and ``columns``
    of it beside the id as ``_tm_row``.  Both come from one numbering, so ids judged in one select in the other."""
    name = fresh_name(docs)
    numbered = with_row_id(docs, name)
    return numbered, numbered.select(F.col(name).alias("_tm_row"), *columns), name


def without_rows(numbered: DataFrame, dropped: DataFrame, row_id: str) -> DataFrame:
    """``numbered`` (see ``keyed``) less the rows whose ids are ``_tm_row`` in ``dropped``, and without the id.

    The id list is counted first: a short one is broadcast, so the texts are
    not shuffled; a long one is joined by shuffle on the row id, which is
    unique and therefore even.
    """
    ids = dropped.select(F.col("_tm_row").alias(row_id))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return numbered.join(ids, row_id, "left_anti").drop(row_id)


def hex_digest(text: Column) -> Column:
    """Lower-case SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def crc32_sql(strings: str) -> str:
    """DuckDB CTEs that end in ``crcs(s, crc)``: the unsigned CRC-32 of each string of a query with one column ``s``.

    The code is linear over XOR, so it is the XOR of what each byte adds by its distance from the end
    (``crc_far``) and of what the starting value adds by the length (``crc_len``).
    """
    return f"""
crc_one AS (SELECT b, list_reduce([b] || [CAST(0 AS BIGINT) FOR x IN range(8)],
                   lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM (SELECT unnest(range(256)) AS b)),
crc_strings AS MATERIALIZED ({strings}),
crc_most AS (SELECT coalesce(max(octet_length(encode(s))), 0) AS n FROM crc_strings),
crc_far AS (SELECT CAST(0 AS BIGINT) AS k, b, v FROM crc_one
            UNION ALL SELECT k + 1, f.b, xor(f.v >> 8, o.v) FROM crc_far f JOIN crc_one o ON o.b = f.v & 255
            WHERE k < (SELECT n FROM crc_most)),
crc_len AS (SELECT CAST(0 AS BIGINT) AS k, CAST(4294967295 AS BIGINT) AS v
            UNION ALL SELECT k + 1, xor(l.v >> 8, o.v) FROM crc_len l JOIN crc_one o ON o.b = l.v & 255
            WHERE k < (SELECT n FROM crc_most)),
crc_bytes AS (SELECT s, octet_length(encode(s)) AS n, unnest(range(octet_length(encode(s)))) AS i, hex(encode(s)) AS h FROM crc_strings),
crcs AS (SELECT s, xor(xor(bit_xor(f.v), any_value(l.v)), 4294967295) AS crc
         FROM crc_bytes JOIN crc_far f ON f.k = n - 1 - i AND f.b = CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)
         JOIN crc_len l ON l.k = n GROUP BY s)"""
