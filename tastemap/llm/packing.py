"""Conflict-constrained best-fit packing of documents into sequences.

A document of more words than a sequence holds is cut into full pieces and a
rest.  Pieces go, longest first, into the open bin with the least room left that
takes them, unless it holds a document of the same source or of the same
duplicate cluster; then the search goes on to the next larger room.  Bins are
kept in the order of their room, with one bitmap of sources and one of clusters
each, so a stretch of bins is tested at a time.

Scale: rows are dealt by a hash of their row number into shards of about
``SHARD_ROWS`` rows, and each shard is packed by itself, so work and memory of a
task are fixed and a hot source or cluster is spread evenly.  The price is at
most a few half-empty bins a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import prepare, table
from tastemap.llm.exact_dedup import normalised

CAPACITY = 2048
SHARD_ROWS = 8192
#: Bins whose bitmaps are tested at a time.
STRETCH = 256


class Bins:
    """Open bins in the order of their room, with bitmaps of what they hold."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity = capacity
        self.words = (max(1, -(-sources // 64)), max(1, -(-clusters // 64)))
        self.room = np.empty(0, np.int64)  # ascending
        self.bin = np.empty(0, np.int64)  # the bin with that room
        self.sources = np.zeros((0, self.words[0]), np.uint64)  # by bin
        self.clusters = np.zeros((0, self.words[1]), np.uint64)
        self.filled: list[int] = []

    def _find(self, size: int, source: int, cluster: int) -> int:
        """The place of the tightest compatible bin, or -1."""
        at = int(np.searchsorted(self.room, size))
        while at < len(self.room):
            some = self.bin[at:at + STRETCH]
            free = (self.sources[some, source // 64] >> np.uint64(source % 64)) & np.uint64(1) == 0
            if cluster >= 0:
                free &= (self.clusters[some, cluster // 64] >> np.uint64(cluster % 64)) & np.uint64(1) == 0
            if free.any():
                return at + int(free.argmax())
            at += len(some)
        return -1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """``(bin, offset in it)`` for a piece; ``cluster`` is -1 if it has no other member."""
        at = self._find(size, source, cluster)
        if at < 0:
            b, room = len(self.filled), self.capacity
            self.filled.append(0)
            if b >= len(self.sources):
                more = max(64, b)
                self.sources = np.vstack([self.sources, np.zeros((more, self.words[0]), np.uint64)])
                self.clusters = np.vstack([self.clusters, np.zeros((more, self.words[1]), np.uint64)])
        else:
            b, room = int(self.bin[at]), int(self.room[at])
            self.room, self.bin = np.delete(self.room, at), np.delete(self.bin, at)
        offset = self.filled[b]
        self.filled[b] += size
        self.sources[b, source // 64] |= np.uint64(1) << np.uint64(source % 64)
        if cluster >= 0:
            self.clusters[b, cluster // 64] |= np.uint64(1) << np.uint64(cluster % 64)
        if room > size:
            at = int(np.searchsorted(self.room, room - size, side="right"))
            self.room, self.bin = np.insert(self.room, at, room - size), np.insert(self.bin, at, b)
        return b, offset


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces of the rows of one shard with ``bin`` and ``offset``, pieces of equal size in the order of the
    rows; columns ``_tm_source, _tm_cluster, _tm_words`` are read, null sources are one source, null clusters none."""
    source = pd.factorize(rows["_tm_source"], use_na_sentinel=False)[0]
    cluster, names = pd.factorize(rows["_tm_cluster"])
    shared = np.bincount(cluster[cluster >= 0], minlength=len(names)) > 1
    number = np.where(shared, np.cumsum(shared) - 1, -1)
    cluster = np.where(cluster >= 0, number[cluster], -1) if len(names) else cluster
    words = rows["_tm_words"].to_numpy(np.int64)
    full = words // capacity
    owner = np.repeat(np.arange(len(rows)), full + (words % capacity > 0))
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(np.r_[0, np.bincount(owner, minlength=len(rows))])[:-1],
                                              np.bincount(owner, minlength=len(rows)))
    size = np.minimum(words[owner] - piece * capacity, capacity)
    order = np.lexsort((piece, owner, -size))
    bins = Bins(capacity, int(source.max(initial=-1)) + 1, int(shared.sum()))
    placed = np.zeros((len(owner), 2), np.int64)
    for i in order:
        placed[i] = bins.put(int(size[i]), int(source[owner[i]]), int(cluster[owner[i]]))
    out = rows.iloc[owner].reset_index(drop=True)
    return out.assign(piece=piece, n_words=size, bin=placed[:, 0], offset=placed[:, 1])


def pack(rows: DataFrame, *, doc_id: str = "doc_id", source: str = "source", cluster: str = "cluster",
         words: str = "words", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, piece, n_words, bin_id, bin_offset``.

    ``bin_id`` is the shard and the bin in it (``shard * 2**32 + bin``).  No bin
    exceeds ``capacity`` or holds two pieces of a source or of a cluster (so no
    two of a document); pieces of equal size go in the order of their ``doc_id``
    (nulls last), source, cluster and words, so the bins do not depend on how the
    rows are stored.  A document
    without words gives one row with no bin.  Null sources conflict as one
    source, null clusters never; null ids and repeated rows are packed like any
    other.  An empty table gives no rows; other columns are ignored.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    plain = rows.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("_tm_source"), F.col(cluster).cast("string").alias("_tm_cluster"),
        F.coalesce(F.col(words).cast("long"), F.lit(0)).alias("_tm_words"))
    alike = ["doc_id", "_tm_source", "_tm_cluster", "_tm_words"]
    # rows that are alike are told apart by their number, so that many of them spread over the shards
    numbered = plain.withColumn("_tm_nth", F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(1))))
    numbered = numbered.withColumn("_tm_shard", F.pmod(F.xxhash64(*alike, "_tm_nth"), F.lit(shards)))
    out = T.StructType([
        numbered.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("piece", "n_words", "bin_id", "bin_offset"))])

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([*alike, "_tm_nth"], kind="stable", ignore_index=True)
        packed = pack_shard(shard, capacity)
        bare = shard[shard["_tm_words"] == 0]
        result = pd.DataFrame({
            "doc_id": packed["doc_id"], "piece": packed["piece"], "n_words": packed["n_words"],
            "bin_id": packed["_tm_shard"] * (1 << 32) + packed["bin"], "bin_offset": packed["offset"]})
        none = pd.DataFrame({"doc_id": bare["doc_id"], "piece": 0, "n_words": 0,
                             "bin_id": pd.NA, "bin_offset": pd.NA})
        return pd.concat([result.astype({"bin_id": "Int64", "bin_offset": "Int64"}),
                          none.astype({"bin_id": "Int64", "bin_offset": "Int64"})]) if len(none) else result

    return numbered.groupBy("_tm_shard").applyInPandas(run, out)


def packable(docs: DataFrame) -> DataFrame:
    """``doc_id, source, cluster, words`` of documents: words are the runs of ``[^\\x20\\x09-\\x0D]``; texts
    that are equal without blanks are one cluster (by hash: a collision only keeps two documents apart)."""
    return docs.select(
        "doc_id", "source", F.xxhash64(normalised(F.col("text"))).alias("cluster"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(packable(docs), **options)


def op8_best_fit_packing(spark, sf_dir):
    """All of ``documents``, in sequences of 2,048 words."""
    prepare(spark)
    return pack_documents(table(spark, sf_dir, "documents"))
