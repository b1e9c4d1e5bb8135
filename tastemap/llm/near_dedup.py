"""Near-duplicate groups with an LSH forest over MinHash signatures.

A document's set holds its distinct 2-word shingles.  Documents with the same
set are one *class*; only classes go on.  Every class has a label of eight
MinHash bytes in each of ``TREES`` orders and a 256-bit sketch.

1. Each order is sorted by label (a range partitioning over all orders at
   once), so the longest-common-prefix neighbours of a row stand around it.  A
   *region* is a run of rows that share a prefix there, and its depth adapts: the
   run of the shallowest prefix that has at most ``SMALL`` rows, and where even
   five bytes are shared by more, the run of ``MIN_DEPTH`` bytes, whatever its size.
   (The shallowest depth considered is the one at which chance alone would
   hardly bring two rows together; it grows with the table.)  The rows of one
   region are candidates if their sketch and size allow a link; a region of more
   than ``REGION`` rows is dealt in blocks, each pair of blocks to one group, so
   that all its pairs are compared.  No depth is ever beyond ``MIN_DEPTH``, so all
   rows that share that many bytes meet.
2. Candidates are joined to *clumps*, connected components of the candidate
   graph; most documents are in none.
3. A clump is dealt in blocks of ``BLOCK`` classes, each pair of blocks to one
   group.  Where that takes fewer copies, a clump of more than ``TREES`` blocks is
   dealt by its regions, each of them in blocks in the same way.  A group compares all
   its full sets at once, by matrix products over the shared shingles, and reports a
   spanning forest of the confirmed links, so no pair is ever a row.  The links give
   the components.

The only things lost are links that meet in no order or fail the sketch: at a
similarity of exactly 0.8 a pair misses all 48 orders with a chance of 5e-7 at
most (that of six bytes; less where regions are shallower) and the sketch with one of 1e-7; more similar pairs far more rarely, and a pair
that shares a clump dealt in blocks is compared anyway.  The size of a region or
clump does not change this; its cost grows with the square of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import BROADCAST_IDS, keyed, prepare, table, without_rows
from tastemap.llm.components import connected_components
from tastemap.llm.shingles import batch_sets, min_hashes, set_identity

WORDS = 2
TREES = 48
LABEL_BYTES = 8
MIN_DEPTH = 6
#: Rows of a region that may be shallower than MIN_DEPTH, and prefixes for each row at the shallowest depth.
SMALL = 16
ROOM = 64
#: Sketches and classes of a block; larger regions and clumps are compared by pairs of blocks.
REGION = 2048
BLOCK = 256
SKETCH_BITS = 256
#: Most differing sketch bits of a candidate; at a similarity of 0.8 the mean is 25.6 and the deviation 4.8.
MAX_DIFFERENT = 53
SEED = 20240917
#: Rows of a sorted order that a task holds at a time (about 100 bytes each).
CHUNK = 1 << 18
#: Rows with sketches that a task holds at a time, besides the group that goes on.
SKETCH_CHUNK = 1 << 14
#: Rows with full sets that a task holds at a time, besides the group that goes on.
SET_CHUNK = 1 << 10
#: Shingles in one matrix product.
COLUMNS = 1 << 13

_SIGNATURE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def _signatures(rows: DataFrame, text: str, words: int) -> DataFrame:
    """``_tm_row, doc_id`` and the signature columns of every row."""
    out = T.StructType([rows.schema["_tm_row"], rows.schema["doc_id"], *_SIGNATURE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = batch_sets(batch.column(text), words)
                mins = min_hashes(sets, TREES * LABEL_BYTES, SEED)
                labels = np.ascontiguousarray((mins >> np.uint32(24)).astype(np.uint8)).view(">u8").astype(np.uint64)
                labels = (labels ^ np.uint64(1 << 63)).view(np.int64)  # signed order is byte order
                sketch = np.packbits((mins[:, :SKETCH_BITS] & np.uint32(1)).astype(np.uint8), axis=1)
                full = np.array([len(s) > 0 for s in sets], bool)
                ends = np.concatenate(([0], np.cumsum(full) * TREES)).astype(np.int32)
                marks = [set_identity(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("_tm_row"), batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(labels[full].ravel())),
                    pa.array([x.tobytes() for x in sketch], pa.binary())], names=[f.name for f in out])

    return rows.select("_tm_row", "doc_id", text).mapInArrow(run, out)


def _ends(keys: np.ndarray) -> np.ndarray:
    """For each row, the end of the run of equal keys that it stands in."""
    if not len(keys):
        return np.empty(0, np.int64)
    cuts = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1
    return np.repeat(cuts, np.diff(np.concatenate(([0], cuts))))


def _regions(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The region of each row, a number that holds the order and the prefix and so is the same in every task."""
    return tree.astype(np.int64) << (8 * MIN_DEPTH) | (label >> (8 * (LABEL_BYTES - MIN_DEPTH))) & ((1 << 8 * MIN_DEPTH) - 1)


def _near(n: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of row numbers size and sketch allow to be similar enough."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    ok = 100 * low >= 80 * high
    a, b = a[ok], b[ok]
    ok[ok] = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= MAX_DIFFERENT
    return ok


def _candidate_heads(group: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The head of each row after joining all pairs of rows of a group that may be similar."""
    ends = _ends(group)
    rows, head, shift = np.arange(len(group)), np.arange(len(group)), 0
    while True:
        shift += 1
        rows = rows[rows + shift < ends[rows]]
        if not len(rows):
            return head
        apart = rows[head[rows] != head[rows + shift]]
        if len(apart):
            apart = apart[_near(n, sketch, apart, apart + shift)]
        if len(apart):
            head = _unite(head, apart, apart + shift)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)


def _collected(batches: Iterator[pa.RecordBatch], key, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that end where ``key`` (of a table) changes; rows of one key stay together."""
    held: list[pa.RecordBatch] = []
    pieces = (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
    for piece in pieces:
        held.append(piece)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = key(whole)
            last = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])
            if last:
                yield whole.slice(0, last)
            held = whole.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(whole: pa.Table, name: str) -> pa.Array:
    column = whole.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _unite(head: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heads (the least row number of a set) after joining the sets of the pairs."""
    while True:
        low, high = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
        if not (low != high).any():
            return head
        np.minimum.at(head, high, low)
        while ((up := head[head]) != head).any():
            head = up


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    return cuts[:-1], np.diff(cuts)


def adapted_regions(tree: np.ndarray, label: np.ndarray, shallowest: int) -> np.ndarray:
    """The region of each of some rows sorted by order and label, named after its first row.

    A run of a shorter prefix is a region if it is small and does not touch the first or the last row, so that
    it is known to be whole: then every row that shares ``MIN_DEPTH`` bytes with one of its rows is in it too.
    """
    deep = _regions(tree, label)
    region = deep.copy()
    for depth in range(MIN_DEPTH - 1, shallowest - 1, -1):  # the shallowest small run is taken last
        start, size = _runs(deep >> (8 * (MIN_DEPTH - depth)))
        whole = (size <= SMALL) & (start > 0) & (start + size < len(deep))
        region = np.where(np.repeat(whole, size), np.repeat(deep[start], size), region)
    return region


def _shallowest(rows: int) -> int:
    """The depth at which there are ``ROOM`` prefixes for each row, ``MIN_DEPTH`` at most."""
    depth = 1
    while depth < MIN_DEPTH and 256 ** depth < ROOM * rows:
        depth += 1
    return depth


def _region_rows(batches: Iterator[pa.RecordBatch], shallowest: int) -> Iterator[pa.RecordBatch]:
    """``(region, sid)`` of rows sorted by order and label, without the regions that are seen to have one row;
    the first and the last region of a table may go on in another one or another task."""
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        region = adapted_regions(_column(whole, "tree").to_numpy(), _column(whole, "label").to_numpy(), shallowest)
        size = _runs(region)[1]
        seen = size.copy()
        seen[[0, -1]] += 1
        keep = np.flatnonzero(np.repeat(seen, size) > 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(region[keep], pa.int64()), _column(whole, "sid").take(pa.array(keep))], names=["region", "sid"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield flush(held)
            held = []
    if held:
        yield flush(held)


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group, those with a candidate there, as ``(region, sid, head)``; ``head`` is a
    row that candidates join them to."""
    for whole in _collected(batches, lambda t: _column(t, "part").to_numpy(), SKETCH_CHUNK):
        part, sid = _column(whole, "part").to_numpy(), _column(whole, "sid").to_numpy()
        head = _candidate_heads(part, _column(whole, "n").to_numpy(), _sketches(_column(whole, "sketch")))
        keep = np.flatnonzero(np.bincount(head, minlength=len(head))[head] > 1)
        yield pa.RecordBatch.from_arrays(
            [_column(whole, "region").take(pa.array(keep)), pa.array(sid[keep]), pa.array(sid[head[keep]])],
            names=["region", "sid", "head"])


def _block_pairs(rows: DataFrame, blocks: str) -> DataFrame:
    """``rows`` once for each pair of blocks that holds their own one; ``least`` and ``greatest`` name the pair."""
    return (rows.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col(blocks)))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
            .withColumns({"least": F.least("mine", "other"), "greatest": F.greatest("mine", "other")}))


def _candidates(signed: DataFrame, partitions: int, most: int) -> DataFrame:
    """``(region, sid, head)``: the classes that have candidates, per region."""
    labelled = signed.select(F.col("_tm_row").alias("sid"), F.posexplode("labels").alias("tree", "label"))
    order = ["tree", "label", F.xxhash64("sid", "tree")]
    shallowest = _shallowest(signed.count())
    met = (labelled.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
           .mapInArrow(lambda batches: _region_rows(batches, shallowest), "region long, sid long")).checkpoint()
    large = (met.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks")).filter("blocks > 1").checkpoint())
    n_large = large.count()
    dealt = met.withColumn("part", F.col("region"))
    if n_large:
        large = F.broadcast(large) if n_large <= BROADCAST_IDS else large
        pairs = _block_pairs(met.join(large, "region"), "blocks")
        dealt = met.join(large, "region", "left_anti").withColumn("part", F.col("region")).unionByName(
            pairs.select("region", "sid", F.xxhash64("region", "least", "greatest").alias("part")))
    sketched = dealt.join(signed.select(F.col("_tm_row").alias("sid"), "n", "sketch"), "sid")
    return (sketched.select("region", "part", "sid", "n", "sketch").repartition(partitions, "part")
            .sortWithinPartitions("part", "sid").mapInArrow(_candidate_rows, "region long, sid long, head long"))


def _groups(active: DataFrame, clumps: DataFrame, block: int) -> DataFrame:
    """``(part, sub, sid)``: the groups that together hold every candidate pair."""
    members = clumps.select(F.col("node").alias("sid"), F.col("root").alias("clump")).unionByName(
        clumps.select(F.col("root").alias("sid"), F.col("root").alias("clump")).distinct())
    sizes = members.groupBy("clump").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    large = members.join(sizes.filter(F.col("blocks") > TREES).select("clump"), "clump", "left_semi")
    held = active.select("region", "sid").distinct().join(large, "sid").checkpoint()
    runs = held.groupBy("region", "clump").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block))
    copies = runs.groupBy("clump").agg(F.sum(F.col("n") * F.col("parts")).alias("copies"))
    sizes = sizes.join(copies, "clump", "left").withColumn(
        "whole", F.coalesce(F.col("n") * F.col("blocks") <= F.col("copies"), F.lit(True))).checkpoint()
    by_blocks = _block_pairs(members.join(sizes.filter("whole").select("clump", "blocks"), "clump"), "blocks").select(
        F.col("clump").alias("part"), "sid", (F.col("least") * (1 << 31) + F.col("greatest")).alias("sub"))
    cut = runs.join(sizes.filter("NOT whole").select("clump"), "clump", "left_semi").select("region", "clump", "parts")
    by_regions = _block_pairs(held.join(cut, ["region", "clump"]), "parts").select(
        F.xxhash64("region", "clump").alias("part"), "sid",
        (-1 - F.col("least") * (1 << 31) - F.col("greatest")).alias("sub"))
    return by_blocks.unionByName(by_regions)


def _sets(rows: DataFrame, text: str, words: int, groups: DataFrame) -> DataFrame:
    """``(part, sub, sid, items)``: every row of ``groups`` with the full set of its class, taken from the
    text, as packed 64-bit hashes.  A short list is broadcast, so that only the sets move."""
    few = groups.count() <= BROADCAST_IDS
    ids = groups.select(F.col("sid").alias("_tm_row")).distinct()
    wanted = rows.join(F.broadcast(ids) if few else ids, "_tm_row", "left_semi").select("_tm_row", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch_sets(batch.column(text), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_tm_row"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "items"])

    return wanted.mapInArrow(run, "sid long, items binary").join(F.broadcast(groups) if few else groups, "sid")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    column = (np.cumsum(common) - 1)[place]
    used = common[place]
    owner, column = owner[used], column[used]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        ones = np.zeros((len(sets), min(COLUMNS, int(common.sum()) - first)), np.float32)
        ones[owner[a:b], column[a:b] - first] = 1
        out += (ones @ ones.T).astype(np.int64)  # at most COLUMNS each, so exact in single precision
    return out


def _links(sets: DataFrame, partitions: int, percent: int) -> DataFrame:
    """``(u, v)``: a spanning forest of the links inside each group."""
    rows = (sets.select("part", "sub", "sid", "items").repartition(partitions, "part", "sub")
            .sortWithinPartitions("part", "sub", "sid"))

    def key(whole: pa.Table) -> np.ndarray:
        return _column(whole, "part").to_numpy() * 0x9E3779B97F4A7C1 + _column(whole, "sub").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _collected(batches, key, SET_CHUNK):
            sid, ends = _column(whole, "sid").to_numpy(), _ends(key(whole))
            items = [np.frombuffer(x, np.uint64) for x in _column(whole, "items").to_pylist()]
            u, v, at = [], [], 0
            while at < len(sid):
                end = int(ends[at])
                sets_here, size = items[at:end], np.array([len(x) for x in items[at:end]])
                shared = _shared_counts(sets_here)
                a, b = np.nonzero(np.triu(100 * shared >= percent * (size[:, None] + size[None, :] - shared), 1))
                head = _unite(np.arange(end - at), a, b)
                moved = np.flatnonzero(head != np.arange(end - at))
                u.append(sid[at + moved])
                v.append(sid[at + head[moved]])
                at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (u, v)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                percent: int = 80, block: int = BLOCK, region: int = REGION) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their shingle sets share at least ``percent`` of
    their union; ``component_id`` is the smallest ``doc_id`` (nulls last) that
    links reach, and one row of a component is kept, the first with that id.
    A text with fewer words than a shingle is one shingle; null, empty and blank
    texts have none, link with nothing and are kept.  Repeated rows are equal
    sets; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))[1]
    return _linked(rows, words, percent, block, region).drop("_tm_row")


def _linked(rows: DataFrame, words: int, percent: int, block: int, region: int) -> DataFrame:
    """``near_groups`` with ``_tm_row`` for ``rows (_tm_row, doc_id, _tm_text)``."""
    if percent != 80:
        raise ValueError("the sketch bound and the number of orders are set for 80 percent")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = _signatures(rows, "_tm_text", words).checkpoint()
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_tm_row")
    classes = (signed.filter("n > 0").groupBy("n", "h1", "h2")
               .agg(F.min("_tm_row").alias("sid"), F.min(first).alias("best"), F.count(F.lit(1)).alias("size"))
               .checkpoint())
    copies = (signed.select("_tm_row", "n", "h1", "h2").join(
        classes.filter("size > 1").select("n", "h1", "h2", "sid"), ["n", "h1", "h2"])
        .filter("_tm_row <> sid").select("_tm_row").checkpoint())
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    active = _candidates(signed.filter("n > 0").join(copies, "_tm_row", "left_anti"), partitions,
                         region).checkpoint()
    clumps = connected_components(active.select(F.col("sid").alias("u"), F.col("head").alias("v")))
    groups = _groups(active, clumps, block).checkpoint()
    roots = connected_components(_links(_sets(rows, "_tm_text", words, groups), partitions, percent))

    placed = (classes.join(roots, classes.sid == roots.node, "left")
              .select("n", "h1", "h2", "best", F.coalesce("root", "sid").alias("root")))
    heads = placed.groupBy("root").agg(F.min("best").alias("head"))
    heads = placed.join(heads, "root").select(F.col("n").alias("n2"), F.col("h1").alias("i1"),
                                              F.col("h2").alias("i2"), "head")
    joined = signed.select("_tm_row", "doc_id", "n", "h1", "h2").join(
        heads, (F.col("n") == F.col("n2")) & (F.col("h1") == F.col("i1")) & (F.col("h2") == F.col("i2")), "left")
    return joined.select(
        "_tm_row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("head._tm_row") == F.col("_tm_row"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80,
                     block: int = BLOCK, region: int = REGION) -> DataFrame:
    """``docs`` with the one document that ``near_groups`` keeps of each component.

    Null and blank texts stay; of repeated rows one stays; an empty table stays empty; all columns come
    back, whatever their names."""
    prepare(docs.sparkSession)
    numbered, rows, name = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))
    dropped = _linked(rows, words, percent, block, region).filter("NOT kept").select("_tm_row").checkpoint()
    return without_rows(numbered, dropped, name)


def op9_near_dedup(spark, sf_dir):
    """All of ``documents``."""
    return near_groups(table(spark, sf_dir, "documents"))
