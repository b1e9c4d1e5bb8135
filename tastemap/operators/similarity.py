"""Exact top-n neighbours by dot product (cosine on L2-normalised input).

Sparse vectors are long tables ``(id, key, w)``: a TF-IDF row is ``(doc, term,
weight)``, a user rating vector is ``(user, product, rating/norm)``.  Dense
vectors are ``(id, vec array<double>)`` (embeddings, latent factors).

Two exact plans, chosen by measured cost (one small sizing job):

* **key join** -- equi-join of left entries with lists of right entries on the
  key.  The lists hold exactly ``P = sum_k df_left(k) * df_right(k)`` entries and
  are shuffled once, by left id, where pairs are summed and ranked.  Many of
  them go in phases, each over a hashed share of the left ids, whose files are
  deleted before the next one.  Used
  when ``P`` is at most a quarter of all ``N_left x N_right`` pairs.
* **block grid** -- when a few keys are in a large share of the rows (a term
  in every document, a product a third of all users rated), the join would
  emit nearly all pairs.  Then rows are placed on a grid of (left chunk x
  right block) cells: every left entry is replicated to each right block and
  every right entry to each left chunk.  A cell holds up to ``CELL_ENTRIES`` of
  each side, so there are few copies; a NumPy kernel scores it in tiles (a dense
  product for frequent keys, sorted entries expanded by key for the rest) and
  returns only the top ``n`` per left row.  No pair is shuffled and
  no group can exceed one cell.

Both plans end with a per-left-id top-``n`` (WindowGroupLimit) over the
candidates; scores are rounded to 6 decimals by one formula (``half_up``) and
ties go to the smaller id.  Ids keep the type of the input, whichever plan runs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import half_up, half_up_array, top_n_per_group
from ..session import delete, ensure_checkpoint_dir, written

LEFT_CHUNK = 1024
RIGHT_BLOCK = 4096
DENSE_KEYS = 1024
JOIN_SHARE = 0.25
#: Key join: entries in one list, products in one part, and products of one left id that meet in one part.
POSTINGS = 1024
PART_PRODUCTS = 1 << 22
HEAVY_PRODUCTS = 1 << 24
#: Entries that move at once, in multiples of those that are read, and the least that are worth a phase of their own.
PHASE_SHARE, PHASE_PRODUCTS = 3, 1 << 25

#: Grid: entries of one side of a cell, and keys of the left side up to which they are broadcast.
CELL_ENTRIES = 1 << 21
BROADCAST_KEYS = 200_000

#: Products that the kernel expands at a time.
EXPANDED = 1 << 21


def _pair_schema(lid, rid) -> T.StructType:
    """Schema of a kernel's result for the id types of the inputs."""
    return T.StructType([T.StructField("lid", lid), T.StructField("rid", rid), T.StructField("score", T.DoubleType())])


def _empty_pairs() -> pd.DataFrame:
    return pd.DataFrame({"lid": [], "rid": [], "score": pd.Series([], dtype="float64")})


def _expand(lk, lr, lw, rk, rr, rw) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(left row, right row, product)`` of all entry pairs that share a key, a bounded
    number at a time; both sides are sorted by key."""
    first, last = np.searchsorted(rk, lk), np.searchsorted(rk, lk, side="right")
    ends = np.cumsum(last - first)
    at = 0
    while at < len(lk):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + EXPANDED, side="right")))
        counts = (last - first)[at:to]
        left = np.repeat(np.arange(at, to), counts)
        right = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[at:to], counts)
        yield lr[left], rr[right], lw[left] * rw[right]
        at = to


def _top_rows(ranked: np.ndarray, lids: np.ndarray, rids: np.ndarray, n: int) -> pd.DataFrame:
    """Top ``n`` finite entries per row of a score block whose columns are
    sorted by id: ties go to the smaller id.

    ``np.partition`` finds each row's n-th largest score in linear time; only
    entries at or above it (ties included) are sorted.
    """
    n_rows, n_cols = ranked.shape
    take = min(n, n_cols)
    if take <= 0 or n_rows == 0:
        return _empty_pairs()
    thr = np.partition(ranked, n_cols - take, axis=1)[:, n_cols - take]
    rr, cc = np.nonzero((ranked >= thr[:, None]) & np.isfinite(ranked))
    vals = ranked[rr, cc]
    order = np.lexsort((cc, -vals, rr))
    rr, cc, vals = rr[order], cc[order], vals[order]
    pos = np.arange(rr.size) - np.searchsorted(rr, rr)
    keep = pos < take
    return pd.DataFrame({"lid": lids[rr[keep]], "rid": rids[cc[keep]], "score": vals[keep]})


def _tile_scores(left: tuple, right: tuple, n_rows: int, n_cols: int, positive_only: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """``scores`` of one tile, and with ``positive_only`` which pairs share a key; sides are ``(row, key code, value)``."""
    l_row, l_key, lv = left
    r_row, r_key, rv = right
    codes = np.unique(np.concatenate((l_key, r_key)))
    l_key, r_key = np.searchsorted(codes, l_key), np.searchsorted(codes, r_key)
    k = len(codes)
    # frequent keys (by right-side count in this tile) go through one dense
    # product, the long tail through per-key outer products
    work = np.bincount(r_key, minlength=k) * np.bincount(l_key, minlength=k)
    dense_keys = np.argsort(-work, kind="stable")[:DENSE_KEYS]
    dense_keys = dense_keys[work[dense_keys] > 0]
    is_dense = np.zeros(k, dtype=bool)
    is_dense[dense_keys] = True
    col_of = np.full(k, -1, dtype=np.int64)
    col_of[dense_keys] = np.arange(dense_keys.size)
    scores = np.zeros((n_rows, n_cols))
    shared = np.zeros((n_rows, n_cols), dtype=bool) if positive_only else None
    if dense_keys.size:
        lm = np.zeros((n_rows, dense_keys.size))
        rm = np.zeros((n_cols, dense_keys.size))
        ld, rd = is_dense[l_key], is_dense[r_key]
        np.add.at(lm, (l_row[ld], col_of[l_key[ld]]), lv[ld])
        np.add.at(rm, (r_row[rd], col_of[r_key[rd]]), rv[rd])
        scores += lm @ rm.T
        if positive_only:
            shared |= ((lm != 0).astype(np.float32) @ (rm != 0).astype(np.float32).T) > 0
    ls, rs = ~is_dense[l_key], ~is_dense[r_key]
    if ls.any() and rs.any():
        lk, lr, lw = l_key[ls], l_row[ls], lv[ls]
        rk, rr, rw = r_key[rs], r_row[rs], rv[rs]
        lo, ro = np.argsort(lk, kind="stable"), np.argsort(rk, kind="stable")
        lk, lr, lw, rk, rr, rw = lk[lo], lr[lo], lw[lo], rk[ro], rr[ro], rw[ro]
        flat, seen = scores.ravel(), shared.ravel() if positive_only else None
        for i, j, product in _expand(lk, lr, lw, rk, rr, rw):
            np.add.at(flat, i * n_cols + j, product)
            if positive_only:
                seen[i * n_cols + j] = True
    return scores, shared


def _by_row(ids: pd.Series, keys: np.ndarray, values: pd.Series) -> tuple[np.ndarray, tuple]:
    """The distinct ids in order, and entries ``(row, key, value)`` sorted by row; a null key is shared with none."""
    found, row = np.unique(ids.to_numpy(), return_inverse=True)
    order = np.argsort(row, kind="stable")
    order = order[keys[order] >= 0]
    return found, (row[order], keys[order], values.to_numpy(dtype=np.float64)[order])


def _tile(side: tuple, at: int, rows: int) -> tuple:
    a, z = np.searchsorted(side[0], [at, at + rows])
    return side[0][a:z] - at, side[1][a:z], side[2][a:z]


def _sparse_kernel(n: int, exclude_self: bool, positive_only: bool, left_tile: int = LEFT_CHUNK, right_tile: int = RIGHT_BLOCK):
    """Score one grid cell of sparse vectors, tile by tile.

    ``left`` rows are entries ``lid, key, v`` where ``vector`` is set and excluded
    pairs ``lid, rid`` elsewhere; ``right`` rows are vector entries ``rid, key, v``.  All columns are scalars (cheap Arrow batches).
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _empty_pairs()
        is_vec = left["vector"].to_numpy(dtype=bool)
        lvec, banned = left[is_vec], left[~is_vec]
        if lvec.empty:
            return _empty_pairs()
        codes, _ = pd.factorize(pd.concat([lvec["key"], right["key"]], ignore_index=True))
        lids, l_side = _by_row(lvec["lid"], codes[: len(lvec)], lvec["v"])
        rids, r_side = _by_row(right["rid"], codes[len(lvec):], right["v"])
        b_rows, b_cols = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not banned.empty:
            b_l, b_r = banned["lid"].to_numpy(), banned["rid"].to_numpy()
            lpos = np.minimum(np.searchsorted(lids, b_l), lids.size - 1)
            rpos = np.minimum(np.searchsorted(rids, b_r), rids.size - 1)
            ok = (lids[lpos] == b_l) & (rids[rpos] == b_r)
            order = np.argsort(lpos[ok], kind="stable")
            b_rows, b_cols = lpos[ok][order], rpos[ok][order]
        out = []
        for a in range(0, lids.size, left_tile):
            rows = lids[a:a + left_tile]
            l_tile = _tile(l_side, a, left_tile)
            first, last = np.searchsorted(b_rows, [a, a + left_tile])
            best = None
            for b in range(0, rids.size, right_tile):
                cols = rids[b:b + right_tile]
                scores, shared = _tile_scores(l_tile, _tile(r_side, b, right_tile), rows.size, cols.size, positive_only)
                valid = shared & (scores > 0) if positive_only else np.ones(scores.shape, dtype=bool)
                if exclude_self:
                    valid &= rows[:, None] != cols[None, :]
                here = (b_cols[first:last] >= b) & (b_cols[first:last] < b + right_tile)
                valid[b_rows[first:last][here] - a, b_cols[first:last][here] - b] = False
                top = _top_rows(np.where(valid, half_up_array(scores), -np.inf), rows, cols, n)
                if best is not None and len(top):  # columns ascend over the tiles, so a stable sort keeps ties by id
                    both = pd.concat([best, top], ignore_index=True).sort_values(
                        ["lid", "score"], ascending=[True, False], kind="stable", ignore_index=True)
                    top = both[both.groupby("lid").cumcount() < n]
                best = best if best is not None and top.empty else top
            out.append(best)
        return pd.concat(out, ignore_index=True)

    return kernel


def phases_of(moved: float, read: float) -> int:
    """Phases that ``moved`` entries, made of ``read`` ones, go in: their files never outgrow what is read by much."""
    return max(1, min(math.ceil(moved / (PHASE_SHARE * max(1, read))), math.ceil(moved / PHASE_PRODUCTS)))


def in_phases(make, phases: int, column: str, spark) -> DataFrame:
    """The rows of ``make(of)``, where ``of(frame)`` keeps a share of the values of ``column``: one share after the
    other is made and written, so that only its files are there."""
    if phases == 1:
        return make(lambda frame: frame)
    path, schema = f"{ensure_checkpoint_dir(spark)}/phases-{uuid.uuid4().hex}", None
    for k in range(phases):
        schema = written(make(lambda frame, k=k: frame.filter(F.pmod(F.xxhash64(column), F.lit(phases)) == k)), f"{path}/{k}").schema
    return spark.read.schema(schema).parquet(*(f"{path}/{k}" for k in range(phases)))


def _pair_sums(l: DataFrame, r: DataFrame, dr: DataFrame, pairs: float, entries: int, same: bool, ranked) -> DataFrame:
    """``ranked`` rows of ``(lid, rid, s)``, ``s`` the sum of ``lw * rw`` over shared keys; ``dr (key, dr)`` counts the right
    entries of a key, ``pairs`` is the number of products and ``entries`` that of right entries.

    What moves are lists of right entries, dealt into ``POSTINGS`` at most: each goes once to every left entry of
    its key, into the part of that ``lid``, where products are made, summed and later ranked without a further
    shuffle.  Where both sides are the ``same``, the only list of a key also holds its left entries.  A ``lid``
    with more than ``HEAVY_PRODUCTS`` is summed by pair over all parts instead.
    """
    spark, phases = l.sparkSession, phases_of(pairs, entries)
    parts = math.ceil(pairs / phases / PART_PRODUCTS)
    enough = parts <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # then AQE may join small parts
    lists = written(r.join(dr, "key").withColumn("s", F.pmod(F.xxhash64("rid"), F.ceil(F.col("dr") / POSTINGS)))
                    .groupBy("key", "s").agg(F.collect_list(F.struct("rid", "rw")).alias("e"), F.max("dr").alias("dr"))
                    .select("key", "dr", F.col("e.rid").alias("rids"), F.col("e.rw").alias("rws")))
    if same:
        one = lists.filter(F.col("dr") <= POSTINGS)
        work = (one.select(F.explode("rids").alias("lid"), "dr")
                .unionByName(l.join(dr.filter(F.col("dr") > POSTINGS), "key").select("lid", "dr")))
    else:
        work = l.join(dr, "key")
    work = written(work.groupBy("lid").agg(F.sum("dr").alias("n")).filter(F.col("n") > HEAVY_PRODUCTS).select("lid"))
    heavy = not work.isEmpty()

    def made(of) -> DataFrame:
        if same:
            met = (of(one.select(F.explode(F.arrays_zip("rids", "rws")).alias("e"), "rids", "rws")
                      .select(F.col("e.rids").alias("lid"), F.col("e.rws").alias("lw"), "rids", "rws"))
                   .unionByName(of(l).join(lists.filter(F.col("dr") > POSTINGS), "key").select("lid", "lw", "rids", "rws")))
        else:
            met = of(l).join(lists, "key").select("lid", "lw", "rids", "rws")
        if heavy:
            met = met.join(work, "lid", "left_anti")
        sums = ((met.repartition("lid") if enough else met.repartition(parts, "lid"))
                .select("lid", "lw", F.explode(F.arrays_zip("rids", "rws")).alias("e"))
                .select("lid", F.col("e.rids").alias("rid"), (F.col("lw") * F.col("e.rws")).alias("p"))
                .groupBy("lid", "rid").agg(F.sum("p").alias("s")))
        if heavy:
            sums = sums.unionByName(of(l).join(work, "lid", "left_semi").join(r, "key")
                                    .select("lid", "rid", (F.col("lw") * F.col("rw")).alias("p"))
                                    .groupBy("lid", "rid").agg(F.sum("p").alias("s")))
        return ranked(sums)

    out = in_phases(made, phases, "lid", spark)
    if phases > 1:
        delete(spark, lists.inputFiles()[0].rpartition("/")[0])
    return out


def cosine_top_n(left: DataFrame, right: DataFrame, n: int, *, exclude_self: bool = False,
                 positive_only: bool = True, exclude_pairs: DataFrame | None = None,
                 method: str = "auto", left_chunk: int = LEFT_CHUNK, right_block: int = RIGHT_BLOCK) -> DataFrame:
    """Top ``n`` right ids per left id by ``sum(w_l * w_r)`` over shared keys.

    ``left``/``right``: ``(id, key, w)`` with integer or string ids, already L2-normalised for a
    cosine.  ``positive_only`` keeps only pairs that share a key and score
    above zero (without it every pair may rank, which forces the grid).
    ``exclude_pairs (lid, rid)`` are never returned.  ``method`` is
    ``'auto'`` (by cost), ``'join'`` or ``'grid'``.  Returns
    ``(lid, rid, score, rank)``.
    """
    same = left is right
    # the inputs feed sizing jobs and the final plan: they are written once to the shared checkpoint folder
    left = written(left)
    if not same:
        # right entries whose key no left row has can never score: they are neither written nor moved
        keys = left.select("key").distinct()
        right = right.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi").checkpoint()
    else:
        right = left
    l = left.select(F.col("id").alias("lid"), F.col("key").alias("key"), F.col("w").alias("lw"))
    r = right.select(F.col("id").alias("rid"), F.col("key").alias("key"), F.col("w").alias("rw"))
    spark = left.sparkSession

    # each side is counted by key once
    dl = written(l.groupBy("key").agg(F.count(F.lit(1)).alias("dl")))
    dr = dl.withColumnRenamed("dl", "dr") if same else written(r.groupBy("key").agg(F.count(F.lit(1)).alias("dr")))
    nl = written(l.agg(F.count_distinct("lid").alias("n"))).first()["n"]
    nr = nl if same else written(r.agg(F.count_distinct("rid").alias("n"))).first()["n"]
    sizes = spark.range(1).select(
        (dl.filter("key IS NOT NULL").select(F.sum(F.col("dl").cast("double") * F.col("dl"))) if same else
         dl.join(dr, "key").select(F.sum(F.col("dl").cast("double") * F.col("dr")))).scalar().alias("pairs"),
        dl.select(F.sum("dl")).scalar().alias("el"), dr.select(F.sum("dr")).scalar().alias("er"),
        dl.select(F.count("key") == F.count_distinct(F.xxhash64("key"))).scalar().alias("distinct_codes"),
    ).first()
    pairs = sizes["pairs"] or 0
    use_join = method == "join" or (method == "auto" and positive_only and pairs <= JOIN_SHARE * nl * nr)

    if use_join:
        def ranked(cand: DataFrame) -> DataFrame:
            if exclude_self:
                cand = cand.filter(F.col("lid") != F.col("rid"))
            if exclude_pairs is not None:
                cand = cand.join(exclude_pairs.select("lid", "rid"), ["lid", "rid"], "left_anti")
            if positive_only:
                cand = cand.filter(F.col("s") > 0)
            return top_n_per_group(cand.select("lid", "rid", half_up("s").alias("score")), "lid", "score", "rid", n)

        return _pair_sums(l, r, dr, pairs, sizes["er"] or 0, same, ranked)

    # every left entry is copied to each right block and every right one to each left chunk: no more of both than keep
    # all cores busy and a cell within its entries
    n_rblocks = max(1, math.ceil((sizes["er"] or 0) / CELL_ENTRIES))
    n_lchunks = max(1, math.ceil((sizes["el"] or 0) / CELL_ENTRIES))
    cores = 2 * spark.sparkContext.defaultParallelism
    most_l, most_r = math.ceil(nl / left_chunk), math.ceil(nr / right_block)
    while n_lchunks * n_rblocks < cores and (n_lchunks < most_l or n_rblocks < most_r):
        fewer = (sizes["el"] or 0) * (n_rblocks + 1) < (sizes["er"] or 0) * (n_lchunks + 1)  # copies of left entries
        if n_rblocks < most_r and (fewer or n_lchunks >= most_l):
            n_rblocks += 1
        else:
            n_lchunks += 1
    # keys only have to be told apart: a long does, and is short
    code = F.xxhash64("key") if sizes["distinct_codes"] else F.col("key").cast("string")
    no_key = F.lit(0).cast("long") if sizes["distinct_codes"] else F.lit("")
    lchunk = F.pmod(F.xxhash64("lid"), F.lit(n_lchunks))
    rblock = F.pmod(F.xxhash64("rid"), F.lit(n_rblocks))
    rid_type = r.schema["rid"].dataType
    nothing = F.lit("" if isinstance(rid_type, T.StringType) else 0).cast(rid_type)  # never read
    left_cells = (l.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rblocks - 1))))
                  .select((lchunk * n_rblocks + F.col("rb")).alias("cell"), "lid", nothing.alias("rid"),
                          code.alias("key"), F.col("lw").alias("v"), F.lit(True).alias("vector")))
    if exclude_pairs is not None:
        banned = (exclude_pairs.select("lid", "rid").distinct()
                  .select((lchunk * n_rblocks + rblock).alias("cell"), "lid", "rid", no_key.alias("key"),
                          F.lit(0.0).alias("v"), F.lit(False).alias("vector")))
        left_cells = left_cells.unionByName(banned)
    right_cells = (r.withColumn("lc", F.explode(F.sequence(F.lit(0), F.lit(n_lchunks - 1))))
                   .select((F.col("lc") * n_rblocks + rblock).alias("cell"), "rid",
                           code.alias("key"), F.col("rw").alias("v")))
    grid = (left_cells.groupBy("cell").cogroup(right_cells.groupBy("cell"))
            .applyInPandas(_sparse_kernel(n, exclude_self, positive_only, left_chunk, right_block),
                           _pair_schema(l.schema["lid"].dataType, rid_type)))
    return top_n_per_group(grid, "lid", "score", "rid", n)


def l2_normalise(long_df: DataFrame, id_col: str, key_col: str, value_col: str) -> DataFrame:
    """``(id, key, w)`` with ``w = v / sqrt(sum v^2)`` per id; zero vectors drop out.

    The norm is a partial aggregation joined back on the id, so one id that
    holds a third of all rows (a power user) never lands whole in one task.
    """
    v = long_df.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), F.col(value_col).alias("v"))
    norms = (v.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
             .filter(F.col("norm") > 0))
    return v.join(norms, "id").select("id", "key", (F.col("v") / F.col("norm")).alias("w"))


#: Fewest rows of a left chunk of dense vectors, and left rows that are scored at a time.
_DENSE_LEFT_CHUNK = 2048
LEFT_TILE = 512
#: Bytes of the vectors of one block of a dense cell, and blocks of the right side up to that.
_DENSE_BYTES = 16 << 20
_DENSE_BLOCKS = 32
#: Bands of similar norm that the right side is cut into; a band holds any number of blocks.
NORM_BANDS = 64
#: Scores are compared after rounding; a bound must clear the last place and the rounding of the products.
_SLACK = 1.1e-6


def _excluded(left: pd.DataFrame, lids: np.ndarray, rids: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (ascending) and columns of the pairs of a cell that never rank."""
    excl = left["excl"].to_numpy()
    counts = np.fromiter((0 if e is None else len(e) for e in excl), dtype=np.int64, count=len(excl))
    rows, cols = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if counts.sum():
        ids = np.concatenate([e for e in excl if e is not None and len(e)])
        cols = np.minimum(np.searchsorted(rids, ids), rids.size - 1)
        hit = rids[cols] == ids
        rows, cols = np.repeat(np.arange(lids.size), counts)[hit], cols[hit]
    if exclude_self:
        first, last = np.searchsorted(rids, lids), np.searchsorted(rids, lids, side="right")
        own = last - first
        mine = np.repeat(np.arange(lids.size), own)
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first, own)
        rows, cols = np.concatenate((rows, mine)), np.concatenate((cols, at))
        order = np.argsort(rows, kind="stable")
        rows, cols = rows[order], cols[order]
    return rows, cols


def _reached(least: np.ndarray) -> np.ndarray:
    """The smallest unrounded score that may equal the rounded score ``least``."""
    return least - _SLACK - 1e-12 * np.abs(least)


def _dense_kernel(n: int, exclude_self: bool):
    """One grid cell of dense vectors: ``left (lid, vec, excl)``,
    ``right (rid, vec)``; scores ``L R^T``, excluded pairs never rank.

    A cell is scored tile by tile.  Each row keeps its best ``n``; only scores that
    reach the ``n``-th of these are rounded and ranked.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty or n <= 0:
            return _empty_pairs()
        right = right.sort_values("rid", kind="stable")
        lids, rids = left["lid"].to_numpy(), right["rid"].to_numpy()
        lm = np.vstack(left["vec"].to_numpy()).astype(np.float64, copy=False)
        rm = np.vstack(right["vec"].to_numpy()).astype(np.float64, copy=False)
        e_rows, e_cols = _excluded(left, lids, rids, exclude_self)
        finite = bool(np.isfinite(np.abs(lm).max(initial=0.0) * np.abs(rm).max(initial=0.0) * max(1, lm.shape[1])))
        out = []
        for a in range(0, lids.size, LEFT_TILE):
            rows = lm[a:a + LEFT_TILE]
            lo, hi = np.searchsorted(e_rows, [a, a + len(rows)])
            x_rows, x_cols = e_rows[lo:hi] - a, e_cols[lo:hi]
            cut = np.full(len(rows), -np.inf)
            rr, cc, vals = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in range(0, rids.size, RIGHT_BLOCK):
                scores = rows @ rm[b:b + RIGHT_BLOCK].T
                if not finite:
                    scores[~np.isfinite(scores)] = -np.inf
                here = (x_cols >= b) & (x_cols < b + scores.shape[1])
                scores[x_rows[here], x_cols[here] - b] = -np.inf
                open_rows = np.isneginf(cut)
                if open_rows.any() and scores.shape[1] > n:
                    at = scores.shape[1] - n
                    nth = np.partition(scores[open_rows], at, axis=1)[:, at]
                    cut[open_rows] = np.where(np.isneginf(nth), nth, _reached(np.where(np.isneginf(nth), 0.0, nth)))
                r, c = np.nonzero(scores >= cut[:, None])
                v = scores[r, c]
                real = np.isfinite(v)
                r, c, v = r[real], c[real] + b, half_up_array(v[real])
                rr, cc, vals = np.concatenate((rr, r)), np.concatenate((cc, c)), np.concatenate((vals, v))
                order = np.lexsort((cc, -vals, rr))
                rr, cc, vals = rr[order], cc[order], vals[order]
                place = np.arange(rr.size) - np.searchsorted(rr, rr)
                rr, cc, vals, place = rr[place < n], cc[place < n], vals[place < n], place[place < n]
                full = place == n - 1
                cut[rr[full]] = np.maximum(cut[rr[full]], _reached(vals[full]))
            out.append(pd.DataFrame({"lid": lids[a + rr], "rid": rids[cc], "score": vals}))
        return pd.concat(out, ignore_index=True)

    return kernel


def _norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x))


def _norm_blocks(right: DataFrame, n_rows: int, rows: int) -> tuple[DataFrame, list[tuple[float, int]]]:
    """``(rid, vec, rb)`` with blocks of about ``rows`` rows, numbered by descending norm, and for each band of
    norms its greatest norm and the first block after it.

    Bands are cut at approximate quantiles of the norm and counted exactly; inside a band rows go to blocks by
    hash, so any number of equal norms is spread.
    """
    normed = right.select(F.col("id").alias("rid"), F.col("vec").alias("vec"), _norm("vec").alias("norm"))
    bands = min(NORM_BANDS, max(1, math.ceil(n_rows / rows)))
    cuts = [] if bands == 1 else normed.agg(
        F.percentile_approx("norm", [i / bands for i in range(1, bands)], 10 * bands)).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    band = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array().cast("array<double>"),
                           lambda c: c > F.col("norm")))
    banded = normed.withColumn("band", band)
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).orderBy("band").collect()
    place, bounds, first = [], [], 0
    for r in sizes:  # NORM_BANDS rows at most
        blocks = max(1, math.ceil(r["n"] / rows))
        place.append((r["band"], first, blocks))
        first += blocks
        bounds.append((r["most"], first))
    numbered = banded.sparkSession.createDataFrame(place, "band int, first int, blocks int")
    return (banded.join(F.broadcast(numbered), "band")
            .select("rid", "vec", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("blocks"))).cast("int").alias("rb")), bounds)


def dense_top_n(left: DataFrame, right: DataFrame, n: int, *, exclude_self: bool = False,
                exclude_pairs: DataFrame | None = None, left_chunk: int | None = None,
                right_block: int | None = None, cells: list | None = None) -> DataFrame:
    """Top ``n`` right ids per left id by the dot product of dense vectors, exactly.

    ``left``/``right``: ``(id, vec array<double>)`` of equal width.  Right rows
    are dealt into blocks by descending norm, left rows into chunks; a NumPy
    kernel scores one ``chunk x block`` cell with one matrix product and keeps
    the top ``n`` per row.  Every left row meets the block of the greatest norms
    first.  Its ``n``-th score there, if it has one, is a bound: no product
    exceeds the product of the norms, so the row goes on only to the blocks
    whose norms still reach it (a prefix of the blocks).  A cell's sides are
    bounded in bytes.  ``exclude_pairs (lid, rid)`` travel with the left row of
    their cell as an id list, which is bounded by the block size.  ``cells``, if
    given, takes the numbers of row-block visits without and with the bound.
    Returns ``(lid, rid, score, rank)``; ties by ``rid``.
    """
    spark = left.sparkSession
    same = left is right
    left = written(left)
    right = left if same else written(right)
    sizes = spark.range(1).select(left.select(F.count(F.lit(1))).scalar().alias("nl"),
                                  right.select(F.count(F.lit(1))).scalar().alias("nr"),
                                  right.select(F.max(F.size("vec"))).scalar().alias("width")).first()
    most_rows = max(64, _DENSE_BYTES // (8 * max(1, sizes["width"] or 1)))
    # every right row is copied to each left chunk and a left row to each block it reaches: no more of both than keep
    # all cores busy and a cell small
    left_chunk = left_chunk or max(_DENSE_LEFT_CHUNK, math.ceil((sizes["nl"] or 0) / (2 * spark.sparkContext.defaultParallelism)))
    right_block = right_block or max(RIGHT_BLOCK, math.ceil((sizes["nr"] or 0) / _DENSE_BLOCKS))
    left_chunk, right_block = min(left_chunk, most_rows), min(right_block, most_rows)
    n_lchunks = max(1, math.ceil((sizes["nl"] or 1) / left_chunk))
    blocked, bounds = _norm_blocks(right, sizes["nr"] or 0, right_block)
    blocked = written(blocked)
    n_rblocks = bounds[-1][1] if bounds else 1
    # copies go in phases of whole left chunks
    phases = phases_of(((sizes["nl"] or 0) * n_rblocks + (sizes["nr"] or 0) * n_lchunks) * (sizes["width"] or 1),
                       ((sizes["nl"] or 0) + (sizes["nr"] or 0)) * (sizes["width"] or 1))
    n_lchunks = -(-n_lchunks // phases) * phases
    rid_type = right.schema["id"].dataType
    no_list = F.array().cast(T.ArrayType(rid_type))
    lists = None
    if exclude_pairs is not None:
        lists = written(exclude_pairs.select("lid", "rid").distinct().join(blocked.select("rid", "rb"), "rid")
                        .groupBy("lid", "rb").agg(F.collect_list("rid").alias("excl")))

    def scored(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """Top ``n`` per left row of each cell; ``rows (lid, vec, rb)``."""
        with_lists = rows.withColumn("excl", no_list) if lists is None else rows.join(lists, ["lid", "rb"], "left")
        lchunk = F.pmod(F.xxhash64("lid"), F.lit(n_lchunks))
        left_cells = with_lists.select((lchunk * n_rblocks + F.col("rb")).alias("cell"), "lid", "vec",
                                       F.coalesce("excl", no_list).alias("excl"))
        wanted = rows.select(lchunk.alias("lc"), "rb").distinct()
        right_cells = blocks.join(wanted, "rb").select((F.col("lc") * n_rblocks + F.col("rb")).alias("cell"), "rid", "vec")
        return (left_cells.groupBy("cell").cogroup(right_cells.groupBy("cell"))
                .applyInPandas(_dense_kernel(n, exclude_self), _pair_schema(left.schema["id"].dataType, rid_type)))

    # fresh aliases keep the sides distinct when left is right
    rows = left.select(F.col("id").alias("lid"), F.col("vec").alias("vec"))
    best = top_n_per_group(scored(rows.withColumn("rb", F.lit(0)), blocked.filter("rb = 0")), "lid", "score", "rid", n)
    if n_rblocks == 1:
        return best
    best = written(best)
    least = best.filter(F.col("rank") == n).select("lid", F.col("score").alias("least"))
    ends = F.array(*(F.struct(F.lit(float(most)).alias("most"), F.lit(int(end)).alias("end")) for most, end in bounds))
    # blocks go down in norm, so those that can still reach the bound are the first ones
    reach = F.aggregate(ends, F.lit(0), lambda end, b: F.when(
        F.col("least").isNull() | (b["most"] * F.col("norm") >= F.col("least") - F.lit(_SLACK)), F.greatest(end, b["end"])).otherwise(end))
    onward = (rows.join(least, "lid", "left").withColumn("norm", _norm("vec")).withColumn("upto", reach)
              .filter("upto > 1").select("lid", "vec", F.explode(F.expr("sequence(1, upto - 1)")).alias("rb")))
    if cells is not None:
        cells += [(sizes["nl"] or 0) * n_rblocks, (sizes["nl"] or 0) + onward.count()]

    def merged(of) -> DataFrame:
        rest = scored(of(onward), blocked.filter("rb > 0"))
        return top_n_per_group(of(best).select("lid", "rid", "score").unionByName(rest), "lid", "score", "rid", n)

    return in_phases(merged, phases, "lid", spark)
