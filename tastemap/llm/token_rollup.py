"""Token counts kept as rollups that signed deltas maintain.

Changes to documents (inserts, deletes, revised counts) become signed rows; a
batch of them is summed by source, language and tokenizer version and written
as one folder of the rollup.  Totals are the sum over the committed batches, so
no batch ever rewrites an older one.

A batch is committed when Spark's committer has left its ``_SUCCESS`` mark.
Committing a committed batch again does nothing; a batch that broke off is
written anew; readers only see committed ones.  So a job that lost its driver
or executors can simply be run again.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.llm.common import prepare, table

KEYS = ("source", "lang", "tokenizer")
#: Default vocabulary file; any file of ranks in the same format will do.
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of that vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def bpe_counts(docs: DataFrame, text: str, *, version: str, ranks_file: str = RANKS_FILE) -> DataFrame:
    """``docs`` without its text, with ``tokenizer`` and ``tokens``: byte-pair tokens of the whole text.

    The vocabulary file is read on the driver and broadcast (a vocabulary is
    about 1 MB); a null text has no tokens.
    """
    with open(ranks_file, "rb") as lines:
        shared = docs.sparkSession.sparkContext.broadcast(lines.read())
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in shared.value.splitlines() if x)}
        encoding = tiktoken.Encoding(version, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                names=[*keep, "tokenizer", "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(run, f"{fields}, tokenizer string, tokens long")


def word_counts(docs: DataFrame, text: str, *, version: str = "words-1") -> DataFrame:
    """The same for words, the runs of ``[^\\x20\\x09-\\x0D]``, by built-in functions."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(*(c for c in docs.columns if c != text), F.lit(version).alias("tokenizer"),
                       words.cast("long").alias("tokens"))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (sign * F.col("tokens")).alias("tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deleted(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the old counts added is taken back and the new ones are added; keys may differ."""
    return _signed(before, -1).unionByName(_signed(after, 1))


class TokenRollup:
    """A rollup in a shared folder: one sub-folder of summed deltas a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._file().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """The ids of the committed batches, sorted."""
        files = self._files()
        if not files.exists(self._file()):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(self._file())]
        return sorted(n.removeprefix("batch-") for n in names
                      if n.startswith("batch-") and files.exists(self._file(n, "_SUCCESS")))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Sum and write the batch; False if it was committed before.  One writer a batch id."""
        if PurePosixPath(batch_id).name != batch_id or not batch_id:
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._files().exists(self._file(f"batch-{batch_id}", "_SUCCESS")):
            return False
        self._summed(deltas).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        return True

    @staticmethod
    def _summed(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over the committed batches; keys
        without documents are left out.  No batch gives no rows."""
        batches = [f"{self.path}/batch-{b}" for b in self.committed()]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)
        return self._summed(rows).filter("docs <> 0 OR tokens <> 0")


def clean_symbols(text: Column) -> Column:
    """The revision that the query applies: runs of junk symbols go."""
    return F.regexp_replace(text, r"[!#$%&*]+", "")


def op4_token_rollup(spark, sf_dir, ranks_file: str = RANKS_FILE):
    """Token totals of ``documents`` by source, language and tokenizer version
    after three batches: all documents come in; those that ``labels`` calls low
    quality go; of the rest that it covers, those with junk symbols are revised.
    The second batch is committed twice.

    Null sources and languages are keys of their own, a null text has no
    tokens, a document with a null id matches no label, and repeated rows count
    as often as they stand there.
    """
    prepare(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def counted(rows: DataFrame) -> DataFrame:
        return bpe_counts(rows, "text", version="byte-bpe-50k-1", ranks_file=ranks_file).unionByName(
            word_counts(rows, "text"))

    counts = counted(documents).checkpoint()
    rollup = TokenRollup(spark, f"{spark.sparkContext.getCheckpointDir()}/token-rollup-{uuid.uuid4().hex}")
    rollup.commit("0", inserted(counts))
    low = labels.filter("quality = 0").select("doc_id")
    for _ in range(2):
        rollup.commit("1", deleted(counts.join(low, "doc_id", "left_semi")))
    fine = labels.filter("quality <> 0").select("doc_id")
    junk = documents.filter(F.col("text").rlike(r"[!#$%&*]")).join(fine, "doc_id", "left_semi")
    after = counted(junk.withColumn("text", clean_symbols(F.col("text"))))
    before = counted(junk)
    rollup.commit("2", revised(before, after))
    return rollup.totals()
