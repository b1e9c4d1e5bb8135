"""Line deduplication by a segment-partition edit join.

Lines (split at ``\\n``, blank ones ignored) are equal, or linked when their edit
distance is at most ``threshold``.  A line of length l is cut into threshold + 1
even segments, of which a linked line of length l to l + threshold must hold one
unchanged, at one of a few places that the lengths allow.  Segments are an
index, the substrings of the longer line at those places probe it, and what
meets is verified by a banded bit-parallel edit distance.

Everything is DataFrame code.  Only hashes move until candidates are known:
index and probe rows hold a key and the line's id (a 64-bit hash).  Each distinct
line takes part once: a line that stands in several places is represented by
the first, so a line that a third of all documents share is one row.  A segment
that more than ``HOT_GROUP`` lines share, as in a family of variants, would join
all of them with each other; these lines also carry sixteen letter counts in four
bits each.  One edit changes these counts by at most two in sum, so the join
itself drops pairs whose counts differ by more than ``2 * threshold`` and yields
no row for them.

The segments of a line under ``SEGMENT_CHARS`` characters are so short that nearly
all such lines would meet.  These lines meet by their deletion neighbourhoods
instead: what is left of a line when up to ``threshold`` characters are deleted.  Two
strings within ``threshold`` edits share such a rest, so every line that is not blank is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import BROADCAST_IDS, keyed, prepare, table
from tastemap.llm.components import connected_components

THRESHOLD = 2
#: Characters of the shortest line that is compared for edits: every line that is not blank has them.
MIN_CHARS = 1
#: From this length on lines meet by segments, below it by what is left after deletions.
SEGMENT_CHARS = 16
HOT_GROUP = 8
#: Letters whose counts are compared.
LETTERS = "etaonirsldhucmgb"


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _exploded(rows: DataFrame, text: str, *more: str) -> DataFrame:
    """``(_tm_row, pos, line, id)`` and ``more``: the non-blank lines, ``id`` a hash of the line."""
    return (rows.select("_tm_row", *more, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
            .filter(F.trim("line") != "").withColumn("id", F.xxhash64("line")))


def _letter_counts(line: Column) -> Column:
    """Sixteen counts modulo 16, four bits each."""
    packed = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(F.lit(15)), 4 * i))
    return packed


def _counts_apart(a: str, b: str) -> Column:
    """A lower bound of the sum of differences of the letter counts."""
    terms = []
    for i in range(len(LETTERS)):
        x = F.shiftrightunsigned(F.col(a), 4 * i).bitwiseAND(F.lit(15))
        y = F.shiftrightunsigned(F.col(b), 4 * i).bitwiseAND(F.lit(15))
        terms.append(F.least((x - y).bitwiseAND(F.lit(15)), (y - x).bitwiseAND(F.lit(15))))
    return sum(terms[1:], terms[0])


def _key(i: int, length: str, place: str, parts: int) -> Column:
    """Key of the substring at ``place`` (from 0) that is as long as segment ``i`` of a line of that length."""
    return F.expr(f"xxhash64({i}, {length}, substring(line, int({place}) + 1, int(({length} + {i}) div {parts})))")


def _start(i: int, length: str, parts: int) -> str:
    """Where segment ``i`` starts: segment k has ``(length + k) div parts`` characters."""
    return " + ".join([f"({length} + {k}) div {parts}" for k in range(i)]) or "0"


def _index_keys(threshold: int) -> list[Column]:
    """Keys of the segments of ``line``, which has ``chars`` characters."""
    return [_key(i, "chars", _start(i, "chars", threshold + 1), threshold + 1) for i in range(threshold + 1)]


def _probe_keys(threshold: int) -> list[list[Column]]:
    """By length difference, the keys of the places where ``line`` can hold a segment of a line that is so much
    shorter.  They lie inside a line of ``SEGMENT_CHARS``: a segment is longer than its shift."""
    out = []
    for apart in range(threshold + 1):
        length, keys = f"(chars - {apart})", []
        for i in range(threshold + 1):
            for shift in range(max(-i, apart - (threshold - i)), min(i, apart + threshold - i) + 1):
                keys.append(_key(i, length, f"{_start(i, length, threshold + 1)} + {shift}", threshold + 1))
        out.append(keys)
    return out


def _rest_keys(threshold: int) -> Column:
    """Keys of the distinct strings that are left of ``line`` after up to ``threshold`` deletions, none included."""
    rests = F.array("line")
    for _ in range(threshold):
        rests = F.array_distinct(F.concat(rests, F.flatten(F.transform(rests, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))),
            lambda i: F.concat(F.left(s, i - 1), F.substring(s, i + 1, F.char_length(s))))))))
    return F.transform(rests, lambda s: F.xxhash64(s))


def line_table(rows: DataFrame, text: str, *more: str, threshold: int = THRESHOLD) -> DataFrame:
    """``(_tm_row, pos, id, keys, first, repeated)`` of every non-blank line: ``keys`` are its
    index keys, null for a line under ``SEGMENT_CHARS``; ``first`` marks one place of each different
    line, ``repeated`` the lines that have several places."""
    lines = _exploded(rows, text, *more).withColumn("chars", F.char_length("line")).select(
        "_tm_row", *more, "pos", "id",
        F.when(F.col("chars") >= SEGMENT_CHARS, F.array(*_index_keys(threshold))).alias("keys")).checkpoint()
    common = lines.groupBy("id").agg(F.min("_tm_row").alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = common.select("id", "r").checkpoint()
    heads = (lines.select("id", "_tm_row", "pos").join(_small(common), "id").filter("_tm_row = r")
             .groupBy("id", "r").agg(F.min("pos").alias("p")).checkpoint())
    return lines.join(_small(heads), "id", "left").withColumn(
        "first", F.expr("r IS NULL OR (r = _tm_row AND p = pos)")).withColumn("repeated", F.col("r").isNotNull()
                                                                          ).drop("r", "p").checkpoint()


def _lines_of(rows: DataFrame, text: str, table_: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, line)`` of the given ids; only documents that hold one are cut up again."""
    places = table_.filter("first").join(_small(ids), "id", "left_semi").select("_tm_row", "pos").checkpoint()
    held = rows.join(_small(places.select("_tm_row").distinct()), "_tm_row", "left_semi")
    return (_exploded(held, text).join(_small(places), ["_tm_row", "pos"], "left_semi").select("id", "line")
            .distinct().checkpoint())


def candidates(rows: DataFrame, text: str, table_: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """Distinct pairs ``(a, b)`` of line ids, ``a < b``, that share a segment where their lengths allow it,
    or of which one is under ``SEGMENT_CHARS`` and both leave the same string after deletions."""
    index = table_.filter("first").select("id", F.explode("keys").alias("key"))
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_GROUP).select("key").checkpoint()
    few = hot.count() <= BROADCAST_IDS
    warm = index.join(F.broadcast(hot), "key", "left_semi").select("id").distinct() if few else index.select("id").distinct()
    counted = _lines_of(rows, text, table_, warm.checkpoint()).select(
        "id", _letter_counts(F.col("line")).alias("counts")).checkpoint()
    index = index.join(_small(counted), "id", "left")

    heads = table_.filter("first AND repeated").select("id", F.col("_tm_row").alias("r"), F.col("pos").alias("p"))
    every = (_exploded(rows, text).join(_small(heads.checkpoint()), "id", "left")
             .filter("r IS NULL OR (r = _tm_row AND p = pos)").withColumn("chars", F.char_length("line")))
    once = every.filter(F.col("chars") >= SEGMENT_CHARS).join(_small(counted), "id", "left")
    by_length = _probe_keys(threshold)
    probes = once.select("id", "counts", F.posexplode(F.array(*(k for keys in by_length for k in keys))).alias("n", "key"))
    probes = probes.select(F.col("id").alias("id2"), F.col("counts").alias("counts2"), "key",
                           (F.col("n") >= len(by_length[0])).alias("longer"))
    met = index.join(probes, "key").filter(
        (F.col("id") != F.col("id2")) & (F.col("longer") | (F.col("id") < F.col("id2")))
        & (F.col("counts").isNull() | F.col("counts2").isNull() | (_counts_apart("counts", "counts2") <= 2 * threshold)))
    met = met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    rests = (every.filter(F.col("chars") < SEGMENT_CHARS + threshold)
             .select("id", F.col("chars").cast("int").alias("chars"), _letter_counts(F.col("line")).alias("counts"),
                     F.explode(_rest_keys(threshold)).alias("key")))
    others = rests.select(F.col("id").alias("id2"), F.col("chars").alias("chars2"), F.col("counts").alias("counts2"), "key")
    short = rests.join(others, "key").filter(
        (F.col("id") < F.col("id2")) & (F.least("chars", "chars2") < SEGMENT_CHARS)
        & (F.abs(F.col("chars") - F.col("chars2")) <= threshold) & (_counts_apart("counts", "counts2") <= 2 * threshold))
    return met.unionByName(short.select(F.col("id").alias("a"), F.col("id2").alias("b"))).distinct()


def _common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings share, by halving."""
    shortest = F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(
        F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0),
        lambda n, step: F.when((step <= shortest - n) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)),
                               n + step).otherwise(n))


def without_common_ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the common prefix and then the common suffix of two string columns taken off;
    the edit distance stays the same."""
    for flip in (False, True):
        pairs = pairs.withColumn("_tm_n", _common_prefix(*(F.reverse(c) if flip else F.col(c) for c in (a, b))))
        pairs = pairs.withColumns({c: (F.left(c, F.char_length(c) - F.col("_tm_n")) if flip
                                       else F.right(c, F.char_length(c) - F.col("_tm_n"))) for c in (a, b)})
        pairs = pairs.drop("_tm_n").checkpoint()  # else the plans below would repeat these expressions
    return pairs


#: Distance of a pair that has left the band for good.
_FAR = 1 << 40


def within_distance(left: Column, right: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most ``threshold`` (Hyyro's
    banded bit-parallel algorithm on the ``2 * threshold + 1`` diagonals around the main one).

    Columns of the matrix belong to ``right``, rows to ``left``.  Bit k in column
    j stands for row ``j - threshold + k``; ``vp`` and ``vn`` mark where a row is one more
    or one less than the row above.  The distance is followed along the lowest
    diagonal down to the last row, then along that row.
    """
    if not 0 < threshold < 31:
        raise ValueError("the band must fit one word")
    top, mask = 2 * threshold, (1 << (2 * threshold + 1)) - 1
    rows, columns = F.char_length(left), F.char_length(right)
    start = F.struct(F.lit(mask & ~((1 << threshold) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
                     F.least(F.lit(threshold), rows).cast("long").alias("dist"))
    places = F.transform(F.split(right, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("j")))
    return (F.when(F.abs(rows - columns) > threshold, False)
            .when((rows == 0) | (columns == 0), True)
            .otherwise(F.aggregate(places, start, lambda s, x: _step(s, x, left, right, threshold, top, mask),
                                   lambda s: s["dist"] <= threshold)))


def _step(state: Column, x: Column, left: Column, right: Column, threshold: int, top: int, mask: int) -> Column:
    """One column of the band; once the distance on the diagonal cannot come back it is set beyond reach."""
    def bits(value: Column) -> Column:
        return value.bitwiseAND(F.lit(mask).cast("long"))

    rows = F.char_length(left)
    near = F.substring(left, F.greatest(x["j"] - threshold, F.lit(1)), F.lit(2 * threshold + 1))
    skipped = F.greatest(F.lit(threshold + 1) - x["j"], F.lit(0))  # bits that stand above row 1
    pm = F.lit(0).cast("long")
    for k in range(2 * threshold + 1):
        same = (F.lit(k) >= skipped) & (F.substring(near, F.lit(k + 1) - skipped, F.lit(1)) == x["c"])
        pm = pm + F.when(same, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    with_pm = F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["dist"].alias("dist"), pm.alias("pm"))

    def first(s: Column) -> Column:
        d0 = bits((s["pm"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["pm"]).bitwiseOR(s["vn"]))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"), d0.alias("d0"))

    def second(s: Column) -> Column:
        hp = bits(s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))))
        return F.struct(s["dist"].alias("dist"), s["d0"].alias("d0"), hp.alias("hp"),
                        s["d0"].bitwiseAND(s["vp"]).alias("hn"))

    def third(s: Column) -> Column:
        moved, one = F.shiftright(s["d0"], 1), F.lit(1).cast("long")
        down = 1 - F.shiftright(s["d0"], top).bitwiseAND(one)
        place = rows - x["j"] + threshold  # the bit of the last row
        along = (F.call_function("shiftright", s["hp"], place).bitwiseAND(one)
                 - F.call_function("shiftright", s["hn"], place).bitwiseAND(one))
        dist = s["dist"] + F.when(x["j"] + threshold <= rows, down).otherwise(along)
        return F.struct(bits(s["hn"].bitwiseOR(F.bitwise_not(moved.bitwiseOR(s["hp"])))).alias("vp"),
                        moved.bitwiseAND(s["hp"]).alias("vn"), dist.alias("dist"))

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    lost = (x["j"] + threshold <= rows) & (state["dist"] > 2 * threshold + F.char_length(right) - rows)
    far = F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), F.lit(_FAR).alias("dist"))
    return F.when(lost, far).otherwise(let(let(let(with_pm, first), second), third))


def line_links(rows: DataFrame, text: str, table_: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` of ids of different lines at most ``threshold`` edits apart; ``table_`` is the
    ``line_table`` of the same rows."""
    pairs = candidates(rows, text, table_, threshold=threshold).checkpoint()
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _lines_of(rows, text, table_, wanted.checkpoint()).withColumn("c", _letter_counts(F.col("line"))).checkpoint()
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("c").alias("ca")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("c").alias("cb")), "b")
            .filter(_counts_apart("ca", "cb") <= 2 * threshold).select("a", "b", "la", "lb"))
    return (without_common_ends(both, "la", "lb")
            .filter(within_distance(F.col("la"), F.col("lb"), threshold)).select("a", "b").distinct().checkpoint())


def line_classes(rows: DataFrame, *, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(lines, classes)`` of ``rows (_tm_row, doc_id, _tm_text)``: every non-blank line as ``(_tm_row, doc_id, pos, id)``
    and, for lines that stand in several places or are linked, ``(id, class_id,
    n_links)``; equal lines share their id, linked ones their class."""
    lines = line_table(rows, "_tm_text", "doc_id", threshold=threshold)
    links = line_links(rows, "_tm_text", lines, threshold=threshold)
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), contract=False)
    degrees = (links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
               .groupBy("id").agg(F.count(F.lit(1)).alias("n_links")))
    classes = (lines.filter("NOT first").select("id").distinct().join(degrees, "id", "full_outer")
               .join(roots.withColumnRenamed("node", "id"), "id", "left")
               .select("id", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
               .checkpoint())
    return lines.select("_tm_row", "doc_id", "pos", "id"), classes


def _with_heads(lines: DataFrame, classes: DataFrame) -> DataFrame:
    shared = lines.join(_small(classes), "id").checkpoint()
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_tm_row", "pos")
    heads = shared.groupBy("class_id").agg(F.min(place).alias("head"))
    return shared.join(heads, "class_id").select(
        "_tm_row", "doc_id", "pos", "id", "class_id", "n_links",
        (~((F.col("head._tm_row") == F.col("_tm_row")) & (F.col("head.pos") == F.col("pos")))).alias("dropped"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, str]:
    prepare(docs.sparkSession)
    return keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The lines that stand in several places or are linked: ``(_tm_row, doc_id, pos, id, class_id,
    n_links, dropped)``.  All but the first of a class are dropped: the one in the
    smallest ``doc_id`` (nulls last), then row, then place.
    """
    return _with_heads(*line_classes(_keyed(docs, doc_id, text)[1], threshold=threshold))


def drop_repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with every line that repeats an earlier one, or is within the threshold of its class, taken
    out of its text.  Blank lines and null texts stay; all columns come back, whatever their names."""
    numbered, rows, name = _keyed(docs, doc_id, text)
    dropped = (_with_heads(*line_classes(rows, threshold=threshold)).filter("dropped")
               .groupBy(F.col("_tm_row").alias(name)).agg(F.collect_set("pos").alias(f"{name}out")))  # of one document
    out = F.col(f"{name}out")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(out, i)), "\n")
    return (numbered.join(dropped, name, "left")
            .withColumn(text, F.when(out.isNull(), F.col(text)).otherwise(kept)).select(*docs.columns))


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document row: ``doc_id, n_lines, n_shared, n_linked, n_links, n_dropped``.

    ``n_lines`` counts non-blank lines, ``n_shared`` those that stand elsewhere too or are linked,
    ``n_linked`` those with a different line within the threshold, ``n_links`` those
    partners (different texts), ``n_dropped`` the lines that are not the first of their class.

    Null, empty and blank texts have no lines.  Repeated rows share all their
    lines; null ids come last in order; an empty table gives no rows; other
    columns are ignored.
    """
    rows = _keyed(docs, doc_id, text)[1]
    lines, classes = line_classes(rows, threshold=threshold)
    counted = _with_heads(lines, classes).groupBy("_tm_row").agg(
        F.count(F.lit(1)).alias("n_shared"), F.count(F.when(F.col("n_links") > 0, 1)).alias("n_linked"),
        F.sum("n_links").alias("n_links"), F.count(F.when(F.col("dropped"), 1)).alias("n_dropped"))
    n_lines = lines.groupBy("_tm_row").agg(F.count(F.lit(1)).alias("n_lines"))
    return (rows.select("_tm_row", "doc_id")
            .join(n_lines, "_tm_row", "left").join(counted, "_tm_row", "left")
            .select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c)
                                for c in ("n_lines", "n_shared", "n_linked", "n_links", "n_dropped"))))


def op7_line_dedup(spark, sf_dir):
    """All of ``documents``."""
    return line_dedup(table(spark, sf_dir, "documents"))
