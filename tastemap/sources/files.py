"""File sources and sinks.

Every read takes an explicit schema (no inference pass over the data); sinks
write through the DataFrame writer, one file per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
                   header: bool = True, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header row.

    Files are split between tasks.  ``multi_line`` lets quoted fields span
    lines, and then each file is one task.
    """
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path))


#: Column of a staged table that holds a malformed record as it stands in the file.
RECORD = "_record"


def ingest_delimited(spark: SparkSession, path: str, schema: StructType | str, out: str, sep: str = ",",
                     header: bool = True, multi_line: bool = False, mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """S1/S2 for files that may be damaged: ``(clean, quarantine)``.

    A record with too few or too many fields, a broken quote or a value that is
    not of its column's type goes to the quarantine with its text and its file
    (``record, source_file``); every other one goes to the clean table.  The
    files are parsed once, with all columns, into ``out``, and both tables are
    partitions of it, so their counts add up to the records of the files.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = (spark.read.schema(StructType([*fields, StructField(RECORD, StringType())]))
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).option("header", header)
              .option("sep", sep).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path))
    staged = parsed.select("*", F.input_file_name().alias("_file"), F.col(RECORD).isNotNull().alias("_bad"))
    staged.write.mode(mode).partitionBy("_bad").parquet(out)
    whole = StructType([*fields, StructField(RECORD, StringType()), StructField("_file", StringType()), StructField("_bad", BooleanType())])
    table = spark.read.schema(whole).parquet(out)
    clean = table.filter(~F.col("_bad")).select(*(f"`{f.name}`" for f in fields))
    return clean, table.filter("_bad").select(F.col(RECORD).alias("record"), F.col("_file").alias("source_file"))


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """S1 ``read_csv(path, sep='\\t')``."""
    return read_delimited(spark, path, schema, sep="\t", multi_line=multi_line)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """S2 ``read_csv(path)``."""
    return read_delimited(spark, path, schema, sep=",", multi_line=multi_line)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """S3: a JSON object ``{"USER_0": 0, ...}`` -> ``(id string, idx int)``.

    Each file is one JSON document; ``wholetext`` reads it as one value and
    ``explode`` turns the map into rows (one map per file, so a map larger
    than a task should be split into several files).
    """
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("id", "idx"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6 ``to_csv(path, index=False)``: header row, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Persist any table of the library (factors, TF-IDF, popularity) as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Reload a persisted table (interactions, factor tables)."""
    return spark.read.parquet(path)


def write_wide_matrix(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7 ``user_item_matrix.to_csv(path, index=True)`` of a frame with a column per product (a few of them):
    the index is the ordinary ``user_id`` column, written first."""
    write_csv(wide, path, mode)


#: Bytes of the column list of a wide export; it goes to every task.
COLUMN_BYTES = 64 << 20


def export_wide_matrix(matrix: DataFrame, path: str, fill: str = "0.0", mode: str = "overwrite") -> int:
    """S7 for all products: the long matrix ``(user_id, product_id, rating)`` as CSV with one row per user and
    one column per product (in product order), ``fill`` where there is no rating; the number of products.

    No frame with a column per product is ever planned.  A user's ratings are
    gathered as one sorted list of (column, rating), at most one entry a column,
    and each row is assembled as a line inside the task, against the column
    list, whose size is checked before it is sent out.  Every file begins with
    the header.  Of repeated pairs the last in order of rating counts; rows with
    a null user or product are left out.
    """
    spark = matrix.sparkSession
    known = matrix.filter("user_id IS NOT NULL AND product_id IS NOT NULL")
    ids = known.select("product_id").distinct()
    size = ids.agg(F.sum(F.length(F.col("product_id").cast("string")) + 16)).first()[0] or 0
    if size > COLUMN_BYTES:
        raise ValueError(f"the column list takes {size} bytes; a matrix with that many columns is exported in its long form")
    columns = [r[0] for r in ids.orderBy("product_id").collect()]  # checked above
    place = spark.createDataFrame(list(enumerate(columns)), T.StructType([
        T.StructField("c", T.IntegerType()), ids.schema["product_id"]])) if columns else None

    def text(value) -> str:
        value = str(value)
        return '"' + value.replace('"', '""') + '"' if any(x in value for x in ',"\n\r') else value

    shared = spark.sparkContext.broadcast(",".join(["user_id", *map(text, columns)]))
    empty = [fill] * len(columns)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [shared.value]
        for batch in batches:
            out = first
            first = []
            for user, row in zip(batch.column("user_id").to_pylist(), batch.column("row").to_pylist(), strict=True):
                values = empty.copy()
                for entry in row:
                    values[entry["c"]] = fill if entry["rating"] is None else repr(entry["rating"])
                out.append(",".join([text(user), *values]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    if not columns:
        spark.createDataFrame([("user_id",)], "value string").coalesce(1).write.mode(mode).text(path)
        return 0
    rows = (known.join(F.broadcast(place), "product_id")
            .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("c", F.col("rating").cast("double").alias("rating")))).alias("row")))
    rows.mapInArrow(lines, "value string").write.mode(mode).text(path)
    return len(columns)
