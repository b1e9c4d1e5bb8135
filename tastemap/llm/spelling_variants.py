"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols.  Every word generates the full
one-edit neighbourhood of its *reduced* word (itself, each deletion, each
replacement and each insertion over the few symbols), which is short however
large the alphabet is, and the neighbourhoods are joined with the reduced
vocabulary.  Two words that are one edit apart have reduced words at most one
edit apart, so no pair is missed; a reduced neighbour need not be a real one,
so every candidate is verified on the original strings inside the join and
only true neighbours leave it.

A reduced word stands as a polynomial over its symbols, so a neighbour's key
follows from running sums of the word without building a string; two keys that
collide add a candidate and never a result.  Words beyond ``LONG`` letters,
whose neighbourhoods would be large, meet by halves instead: one edit leaves
the first or the last half of the shorter word as it is.

Scale: occurrences are counted with map-side partial sums, so a very common
word is folded where it is read.  A word sends about ``8 * length`` keys; a
reduced word that many words share is an ordinary join key, which Spark splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import crc32_sql, prepare, table
from tastemap.llm.shingles import mix

#: Size of the reduced alphabet: fewer symbols make more candidates, more symbols larger neighbourhoods.
SYMBOLS = 4
#: Words of more code points are joined by halves.
LONG = 64
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
RUN = "[A-Za-zÀ-ÿ]"
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _reduced(words: list[str], symbols: int) -> np.ndarray:
    """Symbols (1 to ``symbols``) of words of one length, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return mix(codes.astype(np.uint64)) % np.uint64(symbols) + np.uint64(1)


def _sums(reduced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and the running sums of each row's polynomial, the empty sum first."""
    n, length = reduced.shape
    powers = np.array([pow(_BASE, i, 1 << 64) for i in range(length + 1)], np.uint64)
    sums = np.zeros((n, length + 1), np.uint64)
    np.cumsum(reduced * powers[:-1], axis=1, out=sums[:, 1:])
    return powers, sums


def own_keys(words: list[str], symbols: int) -> np.ndarray:
    """The key of the reduced word of each of ``words``, all of one length."""
    return mix(_sums(_reduced(words, symbols))[1][:, -1])


def neighbour_keys(words: list[str], symbols: int) -> np.ndarray:
    """Keys of the one-edit neighbourhoods of the reduced words, a row for each word (of one length), repeats and all."""
    reduced = _reduced(words, symbols)
    powers, sums = _sums(reduced)
    whole = sums[:, -1:]
    parts = [whole, sums[:, :-1] + (whole - sums[:, 1:]) * np.uint64(_BASE_INV)]
    for a in range(1, symbols + 1):
        parts.append(whole + (np.uint64(a) - reduced) * powers[:-1])
        parts.append(sums + np.uint64(a) * powers + (whole - sums) * np.uint64(_BASE))
    return mix(np.concatenate(parts, axis=1))


def _with_keys(words: DataFrame, symbols: int, neighbours: bool) -> DataFrame:
    """``words`` (``word`` and other columns) with the array ``keys`` of distinct keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            lengths = np.array([len(t) for t in texts])
            rows: list = [None] * len(texts)
            for length in np.unique(lengths).tolist():
                places = np.flatnonzero(lengths == length).tolist()
                group = [texts[i] for i in places]
                if neighbours:
                    keys = np.sort(neighbour_keys(group, symbols).view(np.int64), axis=1)
                    fresh = np.concatenate((np.ones((len(group), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
                else:
                    keys = own_keys(group, symbols).view(np.int64)[:, None]
                    fresh = np.ones_like(keys, bool)
                for place, key, new in zip(places, keys, fresh, strict=True):
                    rows[place] = key[new]
            sizes = np.array([len(r) for r in rows], np.int32)
            values = np.concatenate(rows) if rows else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{columns}, keys array<bigint>")


def _halves(words: DataFrame, probe: bool) -> DataFrame:
    """Keys of both halves of each word, for each length that its neighbours may have."""
    size = F.length("word")
    rows = words.withColumn("other", F.explode(F.array(size - 1, size, size + 1))).withColumn(
        "half", F.expr("CAST(least(length(word), other) / 2 AS INT)"))
    ends = F.array(F.struct(F.lit("p").alias("end"), F.expr("left(word, half)").alias("part")),
                   F.struct(F.lit("s").alias("end"), F.expr("right(word, half)").alias("part")))
    lengths = (size, F.col("other")) if probe else (F.col("other"), size)
    return rows.withColumn("e", F.explode(ends)).withColumn("key", F.xxhash64("e.end", *lengths, "e.part"))


def near_words(vocabulary: DataFrame, *, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """``word, other, other_n``: all ordered pairs of distinct words of ``vocabulary`` (``word, n``) that differ by
    exactly one inserted, deleted or replaced code point, each once.  Words must be distinct, not null and not empty."""
    size = F.length("word")
    one_edit = F.levenshtein(F.col("word"), F.col("other"), 1) == 1
    words = vocabulary.select("word", "n")
    probes = _with_keys(words.filter(size <= long).select("word"), symbols, True).select("word", F.explode("keys").alias("key"))
    targets = _with_keys(words.filter(size <= long + 1), symbols, False).select(
        F.col("keys")[0].alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    short = probes.join(targets, (probes["key"] == targets["key"]) & one_edit)
    left = _halves(words.filter(size > long).select("word"), True).select("key", "word", "half", F.col("e.end").alias("end"))
    right = _halves(words.filter(size >= long), False).select(F.col("key").alias("key2"), F.col("word").alias("other"),
                                                              F.col("n").alias("other_n"))
    first = F.expr("end = 'p' OR left(word, half) <> left(other, half)")  # a pair that shares both halves counts once
    halves = left.join(right, (F.col("key") == F.col("key2")) & first & one_edit)
    return short.select("word", "other", "other_n").unionByName(halves.select("word", "other", "other_n"))


def _roots(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """``word, root`` of ``word, form``: pointers double until the longest possible chain is covered.

    Each link multiplies the count by ``ratio`` at least, so a chain has at most ``log(most) / log(ratio)`` links.
    """
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(most, 1)) / math.log(ratio)))) + 1):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")).checkpoint()
    return now


def group_variants(words: DataFrame, *, ratio: int = RATIO, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """One row per word of ``words`` (``word, n``): ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of the largest ``n`` (ties: the least in code
    point order) if that is at least ``ratio`` (two or more) times the word's
    own ``n``, else null; ``root`` follows forms to the last; ``n_near`` counts
    near words.  Rows with a null or empty word or a null ``n`` are left out,
    counts of repeated words are added up, other columns ignored; an empty
    table gives no rows.
    """
    prepare(words.sparkSession)
    known = (words.filter("word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")).checkpoint())
    near = near_words(known, symbols=symbols, long=long).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    formed = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n")).checkpoint()
    most = formed.agg(F.max("n")).first()[0] or 1
    roots = _roots(formed.filter("form IS NOT NULL"), most, ratio)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).when(word.rlike("[A-Z]"), F.translate(
        word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(word)


def planted_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``word`` of each run of letters, with the contract's slips: where 199 divides ``h = crc32(doc_id:run)``, code
    point ``h % length`` is deleted.  Results under ``min_chars`` are left out, and so are null texts; a null id is empty."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))).alias("raw"))
    runs = runs.select("id", ascii_lower(F.col("raw")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", 1, at), F.substring(F.col("run"), at + 2, F.length("run")))
    return (runs.select("run", h.alias("h")).select(F.when(F.col("h") % 199 == 0, slipped).otherwise(F.col("run")).alias("word"))
            .filter(F.length("word") >= min_chars))


def op12_spelling_variants(spark, sf_dir):
    """Words of all of ``documents``, slips included, with at least five occurrences."""
    prepare(spark)
    counted = (planted_words(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") >= MIN_COUNT))
    return group_variants(counted)


OP12_SQL = rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM documents),
{crc32_sql("SELECT DISTINCT id || ':' || run AS s FROM runs")},
slipped AS (SELECT CASE WHEN crc % 199 = 0 THEN left(run, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) + 2 AS BIGINT))
                   ELSE run END AS word FROM runs JOIN crcs ON s = id || ':' || run),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS t(i)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS most, arg_min(other, (-m, other)) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN best END AS form,
                        CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS place FROM formed
         UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.place WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, walk.place AS root FROM walk JOIN formed f ON f.word = walk.place WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
