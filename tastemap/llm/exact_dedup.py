"""Exact deduplication by deterministic block naming (Karp, Miller, Rosenberg).

Texts are compared after deleting every character of ``[\\x20\\x09-\\x0D]``.  A
normalised text is cut into blocks of 4,096 characters.  Equal blocks meet in
one partition, are sorted there, and the place of the first of them in the
sorted partition is their integer name.  Adjacent names are then paired, and
the distinct pairs are sorted and numbered, until each document holds one
integer; equal integers mean equal texts, without any hash standing for a text.

Scale: the text is shuffled once, as blocks, and sorted by content; from then
on only integers move, half as many on each level.  A block that very many
documents share would fill one partition, so the ``HOT`` most frequent blocks
(found by a count of block hashes, which only decides how rows are dealt) are
dealt over salts in proportion to their counts, named in each, and the few names
they get are merged by comparing the blocks.  A pair that many documents share is collapsed
before its shuffle, and its name comes back by a join that Spark splits.  State is cut with
``checkpoint()`` into the shared folder after each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemap.llm.common import BROADCAST_IDS, hex_digest, keyed, prepare, table, without_rows

BLOCK_CHARS = 4096
#: Blocks dealt over several partitions; any other block has under 1/HOT of all rows.
HOT = 1024
#: Rows of a hot block that share a salt: a block gets salts in proportion to its count.
SALT_ROWS = 512
#: Right half of a pair whose left half is the last name of an odd row.
MISSING = -1


def normalised(text):
    """The text without blanks and ASCII line, tab and page controls; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _blocks(rows: DataFrame, text: str, block_chars: int) -> DataFrame:
    """One row per block; the document's own values stand on its first block only."""
    return (rows.select("_tm_row", "doc_id", F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
                        normalised(F.col(text)).alias("norm"))
            .select("_tm_row", "doc_id", "n_chars", hex_digest(F.col("norm")).alias("sha"),
                    F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)).alias("parts"))
            .select("_tm_row", "doc_id", "n_chars", "sha", F.greatest(F.size("parts"), F.lit(1)).alias("n"),
                    F.posexplode_outer("parts").alias("pos", "block"))
            .select("_tm_row", F.coalesce("pos", F.lit(0)).alias("pos"), "n",
                    F.coalesce("block", F.lit("")).alias("block"),
                    F.expr("CASE WHEN coalesce(pos, 0) = 0 THEN struct(doc_id, n_chars, sha) END").alias("own")))


def _name_blocks(blocks: DataFrame, partitions: int) -> DataFrame:
    """``(_tm_row, pos, n, own, name)`` with one integer per distinct block."""
    key = F.xxhash64("block")
    hot = (blocks.select(key.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(f"c > {SALT_ROWS}")
           .orderBy(F.desc("c"), "h").limit(HOT)
           .select("h", F.lit(True).alias("hot"), F.ceil(F.col("c") / SALT_ROWS).alias("salts")))
    dealt = (blocks.withColumn("h", key).join(F.broadcast(hot), "h", "left")  # at most HOT rows
             .withColumn("salt", F.expr("IF(hot, pmod(xxhash64(_tm_row), salts), 0L)"))
             .repartition(partitions, "block", "salt").sortWithinPartitions("block", "salt")
             .withColumn("seq", F.monotonically_increasing_id())
             .withColumn("name", F.min("seq").over(Window.partitionBy("block", "salt")))
             .select("_tm_row", "pos", "n", "own", "name",
                     F.expr("CASE WHEN hot AND seq = name THEN block END").alias("seen"))
             .checkpoint())
    parts = dealt.filter("seen IS NOT NULL").select("name", "seen")
    merged = (parts.join(parts.groupBy("seen").agg(F.min("name").alias("one")), "seen")
              .filter("one <> name").select("name", "one").checkpoint())
    if merged.count() <= BROADCAST_IDS:
        merged = F.broadcast(merged)
    return (dealt.drop("seen").join(merged, "name", "left")
            .withColumn("name", F.coalesce("one", "name")).drop("one"))


def _name_pairs(current: DataFrame, partitions: int) -> DataFrame:
    """One level up: adjacent names become pairs, distinct pairs are sorted and numbered."""
    pairs = (current.groupBy("_tm_row", F.expr("shiftright(pos, 1)").alias("pos"))
             .agg(F.max(F.expr("CASE WHEN pos % 2 = 0 THEN name END")).alias("l"),
                  F.coalesce(F.max(F.expr("CASE WHEN pos % 2 = 1 THEN name END")), F.lit(MISSING)).alias("r"),
                  F.max(F.expr("shiftright(n + 1, 1)")).alias("n")))
    names = (pairs.select("l", "r").distinct().repartitionByRange(partitions, "l", "r")
             .sortWithinPartitions("l", "r").withColumn("name", F.monotonically_increasing_id()))
    return pairs.join(names, ["l", "r"]).select("_tm_row", "pos", "n", "name").checkpoint()


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in the original text
    stays, then the one with the smallest ``doc_id`` (nulls last), then the
    first row.  Null counts as empty, and all empty texts are one group.  Of
    repeated rows exactly one is kept.  An empty table gives no rows; other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))[1]
    return _groups(rows, block_chars).drop("_tm_row")


def _groups(rows: DataFrame, block_chars: int) -> DataFrame:
    """``exact_groups`` with ``_tm_row`` for ``rows (_tm_row, doc_id, _tm_text)``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = _name_blocks(_blocks(rows, "_tm_text", block_chars), partitions)
    current = named.select("_tm_row", "pos", "n", "name")
    done, level = [], 0
    longest = named.agg(F.max("n")).first()[0] or 1
    while True:
        done.append(current.filter("n = 1").select("_tm_row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        current = _name_pairs(current.filter("n > 1"), partitions)
        level, longest = level + 1, (longest + 1) // 2
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    identified = (named.filter("own IS NOT NULL").select("_tm_row", "own.doc_id", "own.n_chars", "own.sha")
                  .join(identity, "_tm_row").checkpoint())
    best = identified.groupBy("level", "name").agg(
        F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id",
                       "_tm_row")).alias("best"),
        F.count(F.lit(1)).alias("group_size"))
    return identified.join(best, ["level", "name"]).select(
        "_tm_row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("_tm_row") == F.col("best._tm_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with the row that ``exact_groups`` keeps of each group of equal texts.

    Null and blank texts are one group; of repeated rows one stays; an empty table stays empty; all columns
    come back, whatever their names."""
    prepare(docs.sparkSession)
    numbered, rows, name = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))
    return without_rows(numbered, _groups(rows, block_chars).filter("NOT kept").select("_tm_row").checkpoint(), name)


def op3_exact_dedup(spark, sf_dir):
    """All of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""
