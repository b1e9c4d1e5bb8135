"""Benchmark decontamination with one Aho-Corasick automaton.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z.  Every window of 13 consecutive words of a benchmark item (an item with
fewer words, but not none, is one window) becomes one pattern, spaced and
space-delimited; a document is normalised the same way and scanned once.  Hits
are word positions, so the hit words map back to character offsets of the
original text.

The documents are never shuffled: the benchmark, a stated query set, goes to
the workers in blocks of at most ``block_bytes`` and each worker builds the
automaton from a block.  One block (the usual case) is built once per worker;
with more blocks, each batch of documents is scanned block after block, so a
worker never holds two automata.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import keyed, prepare, table, without_rows

WINDOW = 13
BLOCK_BYTES = 16 << 20
_TO_WORD_BYTE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))
_ORIGINAL_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(raw: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return raw.translate(_TO_WORD_BYTE).split()


def build_automaton(items: list[tuple[str, bytes]], window: int):
    """Automaton over the windows of ``(item_id, text)``; the payload is
    ``(number of words, item ids)``.  None when no item has a word."""
    patterns: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, raw in items:
        words = words_of(raw)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            patterns.setdefault(b" " + b" ".join(words[i:i + size]) + b" ", (size, set()))[1].add(item_id)
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for pattern, payload in patterns.items():
        automaton.add_word(pattern.decode("utf-8"), payload)
    automaton.make_automaton()
    return automaton


def scan(automaton, text: str) -> list[tuple[int, int, set[str]]]:
    """``(first word, end word, item ids)`` of every occurrence in a spaced text."""
    found = list(automaton.iter(text))
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 32)
    ends = np.searchsorted(spaces, np.fromiter((e for e, _ in found), np.int64, len(found)))
    return [(int(end) - size, int(end), ids) for end, (size, ids) in zip(ends, (p for _, p in found), strict=True)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_CACHED: dict = {}


def _automata(blocks, window: int, key: str) -> Iterator:
    """The automaton of each block; a single one stays in the worker."""
    if len(blocks) == 1:
        if key not in _CACHED:
            _CACHED.clear()
            _CACHED[key] = build_automaton(blocks[0].value, window)
        yield _CACHED[key]
        return
    for block in blocks:
        yield build_automaton(block.value, window)


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list:
    """The benchmark as broadcast lists of ``(item id, text bytes)``, none of them
    above about ``block_bytes``.  Rows with a null id or a null text are left out."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("raw")
                             ).filter("id IS NOT NULL AND raw IS NOT NULL")
    total = items.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    sc = benchmark.sparkSession.sparkContext
    blocks = []
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "raw"), F.lit(n)) == k)
        blocks.append(sc.broadcast([(r.id, bytes(r.raw)) for r in part.toLocalIterator()]))
    return blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans`` and the ``carry`` columns.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items``
    the items with an occurring window, ``items_sha256`` digests those item ids
    (sorted as strings, comma-joined), ``contaminated`` is ``n_hit > 0 and
    20 * n_hit >= n_words``, and ``spans`` lists the maximal hit passages as
    character offsets ``(start, end)`` of the original text.

    A null or empty text has no words and is clean.  Repeated documents and
    null ids give one row each.  Repeated items count once per id; items with a
    null id or text are ignored; an empty benchmark leaves everything clean.
    Other columns of either table are ignored unless carried.
    """
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("_tm_text"), *carry)
    out = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType),
        *(source.schema[c] for c in carry),
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    none, key = hashlib.sha256(b"").hexdigest(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_tm_text")
            spaced: list[str] = []
            n_words: list[int] = []
            for raw in texts.cast(pa.binary()).to_pylist():
                words = words_of(raw or b"")
                n_words.append(len(words))
                spaced.append(f" {b' '.join(words).decode('utf-8')} " if words else "")
            hits: dict[int, list[tuple[int, int, set[str]]]] = {}
            for automaton in _automata(blocks, window, key):
                for i, text in enumerate(spaced):
                    if automaton is not None and text and (found := scan(automaton, text)):
                        hits.setdefault(i, []).extend(found)
            n_hit, n_items = [0] * len(spaced), [0] * len(spaced)
            digest, spans = [none] * len(spaced), [[] for _ in spaced]
            for i, found in hits.items():
                change = np.zeros(n_words[i] + 1, np.int64)
                np.add.at(change, [f[0] for f in found], 1)
                np.add.at(change, [f[1] for f in found], -1)
                hit = np.cumsum(change[:-1]) > 0
                ids = sorted(set().union(*(f[2] for f in found)))
                n_hit[i], n_items[i] = int(hit.sum()), len(ids)
                digest[i] = hashlib.sha256(",".join(ids).encode()).hexdigest()
                places = [m.span() for m in _ORIGINAL_WORD.finditer(texts[i].as_py())]
                spans[i] = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in _runs(hit)]
            bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in carry),
                 pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(bad, pa.bool_()), pa.array(spans, span_type)],
                names=[f.name for f in out])

    return source.mapInArrow(run, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that ``decontaminate`` calls contaminated.

    Null and empty texts stay; repeated rows go or stay together; an empty table of documents stays empty, and
    nothing goes for an empty benchmark; all columns come back, whatever their names."""
    prepare(docs.sparkSession)
    numbered, rows, name = keyed(docs, F.col(text).alias("text"))
    judged = decontaminate(rows, benchmark, doc_id="_tm_row", **options)
    dropped = judged.filter("contaminated").select(F.col("doc_id").alias("_tm_row")).checkpoint()
    return without_rows(numbered, dropped, name)


def op1_decontaminate(spark, sf_dir):
    """All of ``documents`` against all of ``benchmark``."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_CLASS}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, sizes)),
hit AS (SELECT g.doc_id, g.k, g.i, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.s = win.s),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
