"""Quality classifier: a factorisation machine over words, structure and metadata.

A text's features are its hashed words (frequencies, scaled to length one), one
bin for each of a few structure statistics, and one feature for each metadata
value.  The machine adds to a linear model the products of all feature pairs,
each weighted by the inner product of two low-rank vectors.  Pairs are never
enumerated: per factor, the sum over pairs is half of the squared sum less the
sum of squares, so a text is scored in time linear in its features.

The machine is fitted on a bounded sample: the ``FIT_ROWS`` labelled ids of
each class with the least hashes, and of their rows as many as hold
``FIT_FEATURES`` features together.  Rows are weighted so that the classes
count as in all labels.  Everything else covers all rows: texts are scored
whole, where they are read, with a model of fixed size and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm import shingles
from tastemap.llm.common import prepare, table

#: Bound of the fit: labelled ids of each class, and features of all their rows.
FIT_ROWS = 4000
FIT_FEATURES = 8_000_000
WORD_BUCKETS = 1 << 16
META_BUCKETS = 1 << 10
BINS = 16
RANK = 8
EPOCHS, BATCH, RATE, SHRINK, SEED = 10, 128, 0.08, 1e-5, 7

#: Structure statistics, in the order of ``statistics``.
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "high", "distinct_words", "repeated_next",
              "commonest_word", "bare_symbols", "symbol_ends", "all_caps", "line_words", "distinct_lines", "stops")
_KIND = np.zeros(256, np.uint8)  # 0 symbol, 1 blank, 2 lower, 3 upper, 4 digit, 5 high
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 2, 3, 4, 5
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_PAUSE = _STOP.copy()
_PAUSE[[ord(c) for c in ",;:"]] = True
_PUNCTUATION_ENDS = _PAUSE | (_KIND != 0)


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, read off running sums of a polynomial."""
    up, down = shingles._powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(low)], out=sums[1:])
    return shingles.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights, and the structure statistics of a text given as its bytes."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.float32), np.zeros(len(STATISTICS))
    kind = _KIND[raw]
    low = raw + ((kind == 3) * np.uint8(32))
    inside = np.concatenate(([False], kind != 1, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    breaks = np.flatnonzero(raw == 10)
    line_from, line_to = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
    spans = _hashes(low, np.concatenate((starts, line_from)), np.concatenate((ends, line_to)))
    words, lines = spans[:len(starts)], spans[len(starts):]
    n = max(1, len(words))
    counts = np.bincount(kind, minlength=6)
    letters, visible = max(1, counts[2] + counts[3] + counts[5]), max(1, len(raw) - counts[1])
    _, times = np.unique(words, return_counts=True)
    solid = np.concatenate(([0], np.cumsum((kind >= 2))))
    lowered = np.concatenate(([0], np.cumsum((kind == 2) | (kind == 5))))
    uppers = np.concatenate(([0], np.cumsum(kind == 3)))
    bare = (solid[ends] == solid[starts]).sum()
    caps = ((uppers[ends] - uppers[starts] > 1) & (lowered[ends] == lowered[starts])).sum()
    last = raw[ends - 1]
    filled = lines[line_to > line_from]
    stats = np.array([
        np.log1p((raw & 0xC0 != 0x80).sum()), np.log1p(len(words)), len(raw) / n, counts[3] / letters, counts[4] / visible,
        counts[0] / visible, counts[5] / visible, len(times) / n, (words[1:] == words[:-1]).sum() / n,
        times.max() / n if len(times) else 0.0, bare / n, (~_PUNCTUATION_ENDS[last]).sum() / n, caps / n,
        np.log1p(len(words) / max(1, len(filled))), len(np.unique(filled)) / max(1, len(filled)), _STOP[last].sum() / n])
    buckets, times = np.unique((words % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    weights = np.sqrt(times)  # damped frequencies: a repeated word does not drown the others
    return buckets, (weights / max(1e-9, np.sqrt((weights ** 2).sum()))).astype(np.float32), stats


def _bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    none = np.empty(0, np.uint8)
    for value in texts.cast(pa.large_binary()):
        raw = value.as_buffer()
        yield none if raw is None or not raw.size else np.frombuffer(raw, np.uint8)


class Machine:
    """A fitted factorisation machine; its size does not depend on the data."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges  # one row of inner bin edges for each statistic
        size = WORD_BUCKETS + META_BUCKETS + len(STATISTICS) * BINS
        self.bias = 0.0
        self.linear = np.zeros(size, np.float32)
        self.factors = np.random.default_rng(SEED).normal(0, 0.05, (size, RANK)).astype(np.float32)

    def places(self, buckets: np.ndarray, weights: np.ndarray, stats: np.ndarray, meta: list[int]):
        """Feature places and values of one text."""
        bins = [WORD_BUCKETS + META_BUCKETS + j * BINS + int(np.searchsorted(edges, x, side="right"))
                for j, (edges, x) in enumerate(zip(self.edges, stats.tolist(), strict=True))]
        some = [WORD_BUCKETS + m for m in meta] + bins
        return (np.concatenate((buckets, np.array(some, np.int64))),
                np.concatenate((weights, np.full(len(some), 1 / np.sqrt(len(some)), np.float32))))

    def logits(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of the rows that begin at ``starts``, the factor sums, and the scaled vectors behind them."""
        scaled = self.factors[places] * values[:, None]
        sums = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled * scaled, starts)
        out = self.bias + np.add.reduceat(self.linear[places] * values, starts) + 0.5 * (sums * sums - squares).sum(axis=1)
        return out.astype(np.float64), sums, scaled

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> None:
        """Weighted logistic loss, by steps of AdaGrad over short batches in a seeded order."""
        draw = np.random.default_rng(SEED)
        share = float(np.clip((labels * weights).sum() / weights.sum(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        seen_linear, seen_factors = np.full_like(self.linear, 1e-6), np.full_like(self.factors, 1e-6)
        for _ in range(EPOCHS):
            order = draw.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                places = np.concatenate([rows[i][0] for i in chosen])
                values = np.concatenate([rows[i][1] for i in chosen])
                sizes = np.array([len(rows[i][0]) for i in chosen])
                logits, sums, scaled = self.logits(places, values, np.cumsum(sizes) - sizes)
                slope = (weights[chosen] * (1 / (1 + np.exp(-logits)) - labels[chosen]) / weights[chosen].sum()).astype(np.float32)
                of = np.repeat(np.arange(len(chosen)), sizes)
                pull = (slope[of] * values)[:, None]
                by_place = np.argsort(places, kind="stable")
                first = np.flatnonzero(np.diff(places[by_place], prepend=-1))
                touched = places[by_place][first]
                flat = np.add.reduceat(pull[by_place, 0], first) + SHRINK * self.linear[touched]
                deep = np.add.reduceat((pull * (sums[of] - scaled))[by_place], first) + SHRINK * self.factors[touched]
                seen_linear[touched] += flat * flat
                seen_factors[touched] += deep * deep
                self.linear[touched] -= RATE * flat / np.sqrt(seen_linear[touched])
                self.factors[touched] -= RATE * deep / np.sqrt(seen_factors[touched])
                self.bias -= RATE * float(slope.sum())
        self.factors[seen_linear <= 1e-6] = 0  # a feature that the fit never saw says nothing


def _meta_columns(metadata: dict[str, Column] | None) -> Column:
    """Places of the metadata values: a hash of name and value each; null is a value as well."""
    places = [F.pmod(F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit(""))), F.lit(META_BUCKETS)).cast("int")
              for name, value in (metadata or {}).items()]
    return F.array(*places) if places else F.array().cast("array<int>")


_SAMPLE = T.StructType([
    T.StructField("place", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("meta", T.ArrayType(T.IntegerType())),
    T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType())),
    T.StructField("stats", T.ArrayType(T.DoubleType()))])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [text_features(raw) for raw in _bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("label"), batch.column("meta"),
             pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
             pa.array([m[1] for m in made], pa.list_(pa.float32())), pa.array([m[2] for m in made], pa.list_(pa.float64()))],
            names=[f.name for f in _SAMPLE])


def fit_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                metadata: dict[str, Column] | None = None, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> Machine:
    """The machine of a bounded sample of the labelled rows of ``docs`` (joined by ``doc_id``).

    ``label`` is 0 or 1; rows with a null id or another label are left out.  An
    id labelled both ways counts as its lesser label; of several rows with one
    id the least text counts.  Without labelled rows the machine scores 0.5.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
             .withColumn("place", F.xxhash64("id")).checkpoint())
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy("place", "id").limit(fit_rows)
        ids = some if ids is None else ids.unionByName(some)
    chosen = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                         _meta_columns(metadata).alias("meta")).join(F.broadcast(ids), "id")  # 2 * fit_rows ids
    rows = (chosen.groupBy("id", "label", "place").agg(F.min(F.struct("text", "meta")).alias("one"))
            .select("place", "label", "one.meta", "one.text").mapInArrow(_sample_features, _SAMPLE).checkpoint())
    # the order by hash is the same whatever the partitions; the running total keeps the driver's copy bounded
    lengths = rows.select("place", F.size("buckets").alias("n")).orderBy("place").collect()  # 2 * fit_rows rows
    total, last = 0, None
    for r in lengths:
        total += r["n"] + len(STATISTICS)
        if total > fit_features and last is not None:
            break
        last = r["place"]
    sample = rows.filter(F.col("place") <= (last if last is not None else 0)).orderBy("place", "label").collect()
    stats = np.array([r["stats"] for r in sample]).reshape(len(sample), len(STATISTICS))
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    machine = Machine(np.quantile(stats, steps, axis=0).T if len(sample) else np.zeros((len(STATISTICS), BINS - 1)))
    if sample:
        target = np.array([r["label"] for r in sample], np.float64)
        taken = np.bincount(target.astype(int), minlength=2)
        weights = np.array([sizes[int(y)] / taken[int(y)] for y in target])
        machine.fit([machine.places(np.array(r["buckets"], np.int64), np.array(r["weights"], np.float32), s, r["meta"])
                     for r, s in zip(sample, stats, strict=True)], target, weights / weights.mean())
    else:
        machine.factors[:] = 0
    return machine


def score_quality(docs: DataFrame, machine: Machine, *, keep: list[str], text: str = "text",
                  metadata: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: label 1 is likelier) of every row.

    A null text counts as empty; an empty one is scored by its structure and
    metadata.  Repeated rows are scored alike, an empty table gives no rows,
    and columns that are not named are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(machine)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_tm_text"), _meta_columns(metadata).alias("_tm_meta"))
    out = T.StructType([*(source.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            rows = [fitted.places(*text_features(raw), meta) for raw, meta in zip(
                _bytes(batch.column("_tm_text")), batch.column("_tm_meta").to_pylist(), strict=True)]
            scores = np.empty(0)
            if rows:
                sizes = np.array([len(r[0]) for r in rows])
                logits = fitted.logits(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]),
                                       np.cumsum(sizes) - sizes)[0]
                scores = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())],
                                             names=[*keep, "score"])

    return source.mapInArrow(run, out)


#: The contract's threshold, and the remainder of the ids whose labels are held out.
THRESHOLD, HELD_OUT = 0.7, 2


def is_held_out(doc_id: Column) -> Column:
    """Whether the contract keeps an id's label from the fit; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def op11_quality_fm(spark, sf_dir):
    """All of ``documents``; of its columns only the text and ``n_chars`` (its power of two) are inputs."""
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    metadata = {"n_chars": F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1))}
    machine = fit_quality(docs, labels.filter(~is_held_out(F.col("doc_id"))), metadata=metadata)
    return score_quality(docs, machine, keep=["doc_id"], metadata=metadata).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
