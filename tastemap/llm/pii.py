"""Personal data: base patterns and bootstrapped contextual extraction.

All of it is DataFrame code.  The text is read once; a regular expression's
matches and the gaps between them give the offsets, as running sums over the
matches of one document.  Only matches and their contexts (80 characters) move.

The bootstrap works on *phrases*, runs of tokens that hold a digit or ``@``.
A phrase that holds a valid base entity is a seed of its kind.  The words
around a phrase are its lexical patterns: the two words before it, and the word
before with the word after.  Patterns and phrase texts form a bipartite graph
that is scored until it settles: a pattern's confidence in a kind is the mean score of
its distinct instances (one more in the divisor), an instance's score is the
noisy-or of its patterns, seeds stay at 1.  Patterns with ``min_support``
distinct seeds and a confidence of ``threshold`` mark the other phrases in their
context as personal data of that kind.  These count as support as well, and
patterns that they bring in are scored with the rest, until none is new.

Scale: the graph is made of distinct (pattern, instance) pairs, so a context
shared by a third of all rows is collapsed before its shuffle; only patterns
with enough seeds take part in the joins, and Spark splits their hot keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemap.llm.common import delete_folder, hex_digest, keyed, prepare, table, written
from tastemap.session import ensure_checkpoint_dir

BASE_KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
THRESHOLD = 0.8
#: Scores have settled when no confidence changes by more than ``SETTLED``; not after ``ROUNDS`` rounds is an error.
SETTLED = 1e-9
ROUNDS = 1000
CONTEXT_CHARS = 80

#: The contract's patterns.  Possessive runs, and starts at the front of a run only (or where the
#: last match ended), find the same matches and stay linear on very long runs.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phrase": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _matches(text: Column, kind: str) -> Column:
    """Array of ``(kind, gap, before, after, match)``: each gap and the match that ends it;
    the last gap has no match."""
    pattern = F.lit(_PATTERNS[kind])
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(
        F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT_CHARS)).alias("before"),
        F.left(g, F.lit(CONTEXT_CHARS)).alias("after")))
    return F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(
        F.lit(kind).alias("kind"), g["gap"].alias("gap"), g["before"].alias("before"), g["after"].alias("after"),
        m.alias("match")))


def _valid(kind: Column, match: Column) -> Column:
    """The checks that a pattern alone cannot make; a failing match is dropped."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.when(c.cast("int") >= 5, 1).otherwise(0)))
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
    return (F.when(kind == "ip", small)
            .when(kind == "card", F.when(n.between(14, 19), luhn).otherwise(False))
            .when(kind == "phone", n.between(10, 15))
            .otherwise(True))


def find_matches(rows: DataFrame, text: str) -> DataFrame:
    """``(_tm_row, kind, start, end, match, before, after)`` of all valid matches
    and phrases; offsets in code points, end exclusive."""
    t = F.col("_tm_text")
    per_kind = [F.when(t.contains(_NEEDS[k]) if k in _NEEDS else F.lit(True), _matches(t, k)) for k in _PATTERNS]
    listed = (rows.select("_tm_row", F.col(text).alias("_tm_text"))
              .filter(t.rlike("[0-9@]"))
              .select("_tm_row", F.explode(F.flatten(F.filter(F.array(*per_kind), lambda a: a.isNotNull()))).alias("m"))
              .select("_tm_row", F.monotonically_increasing_id().alias("seq"), "m.*"))
    order = Window.partitionBy("_tm_row", "kind").orderBy("seq")
    size = F.coalesce(F.length("match"), F.lit(0))
    return (listed.withColumn("end", F.sum(F.col("gap") + size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("after", F.lead("after").over(order))
            .filter(F.col("match").isNotNull() & _valid(F.col("kind"), F.col("match")))
            .select("_tm_row", "kind", (F.col("end") - size).alias("start"), "end", "match", "before", "after"))


def _phrases(found: DataFrame) -> DataFrame:
    """Phrases as ``(_tm_row, start, end, instance, seed, patterns)``; ``seed`` is the base kind that begins
    inside, and phrases that only overlap a base entity are left out."""
    is_base = F.col("kind") != "phrase"
    by_place = Window.partitionBy("_tm_row").orderBy("start", is_base, "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = (found.withColumn("p_start", F.last(F.when(~is_base, F.col("start")), True).over(by_place))
              .withColumn("p_end", F.last(F.when(~is_base, F.col("end")), True).over(by_place))
              .withColumn("covered", F.max(F.when(is_base, F.col("end"))).over(by_place)))
    seeds = (placed.filter(is_base & (F.col("start") < F.col("p_end")))
             .groupBy("_tm_row", F.col("p_start").alias("start")).agg(F.min("kind").alias("seed")))
    last = F.lower(F.regexp_extract("before", r"(\S+)\s*$", 1))
    last2 = F.lower(F.regexp_extract("before", r"(\S+)\s+\S+\s*$", 1))
    first = F.lower(F.regexp_extract("after", r"^\s*(\S+)", 1))
    patterns = F.filter(F.array(
        F.when((last != "") & (last2 != ""), F.concat_ws(" ", F.lit("before:"), last2, last)),
        F.when((last != "") & (first != ""), F.concat_ws(" ", F.lit("around:"), last, F.lit("_"), first)),
    ), lambda p: p.isNotNull())
    return (placed.filter(~is_base & (F.coalesce("covered", F.lit(0)) <= F.col("start")))
            .select("_tm_row", "start", "end", F.regexp_replace("match", r"^\p{Punct}+|\p{Punct}+$", "").alias("instance"),
                    patterns.alias("patterns"))
            .join(seeds, ["_tm_row", "start"], "left"))


def _may_be(instance: Column, kind: Column) -> Column:
    """Whether a phrase can be of the kind at all: an ``@`` for an address, else three characters of ``[0-9@]``."""
    return (F.length(F.regexp_replace(instance, "[^0-9@]", "")) >= 3) | ((kind == "email") & instance.contains("@"))


def _settled(graph: DataFrame, seeds: DataFrame, confidence: DataFrame, rounds: int) -> DataFrame:
    """``confidence`` (of ``pattern, kind``) carried on, from below, until it settles.

    An instance's score is ``1 - q * (1 - confidence)`` in the confidence of one of its patterns, ``q`` being the product
    over its other patterns, so each round solves every pattern's equation for itself exactly.  A pattern
    with far more unseen instances than seeds then settles as fast as any other.  Each round is written down
    (see ``written``), and the one before it deleted.
    """
    folder, last = f"{ensure_checkpoint_dir(graph.sparkSession)}/settled-{uuid.uuid4().hex}", None
    unseen = graph.join(seeds.select("instance"), "instance", "left_anti").checkpoint()
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    held = graph.join(seeds, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("s"))
    counts = (confidence.select("pattern", "kind").join(sizes, "pattern").join(held, ["pattern", "kind"], "left")
              .select("pattern", "kind", "n", F.coalesce("s", F.lit(0)).alias("s")).checkpoint())
    for number in range(rounds):
        doubts = unseen.join(confidence, "pattern").select(
            "pattern", "instance", "kind", F.log1p(-F.col("confidence")).alias("doubt"))
        whole = doubts.groupBy("instance", "kind").agg(F.sum("doubt").alias("whole"))
        others = (doubts.join(whole, ["instance", "kind"]).groupBy("pattern", "kind")
                  .agg(F.count(F.lit(1)).alias("k"), F.sum(F.exp(F.col("whole") - F.col("doubt"))).alias("q")))
        k, q = F.coalesce("k", F.lit(0)), F.coalesce("q", F.lit(0.0))
        path = f"{folder}/{number}"
        moved = written(counts.join(others, ["pattern", "kind"], "left")
                        .select("pattern", "kind", ((F.col("s") + k - q) / (F.col("n") + 1 - q)).alias("moved"))
                        .join(confidence, ["pattern", "kind"]), path)
        change = moved.agg(F.max(F.abs(F.col("moved") - F.col("confidence")))).first()[0]
        confidence = moved.select("pattern", "kind", F.col("moved").alias("confidence"))
        if last:
            delete_folder(graph.sparkSession, last)
        last = path
        if change is None or change <= SETTLED:
            return confidence
    raise RuntimeError(f"confidences still change by {change} after {rounds} rounds")


def score_patterns(phrases: DataFrame, *, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD,
                   rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, kind, confidence)`` of the settled pattern-instance graph."""
    edges = (phrases.select(F.explode("patterns").alias("pattern"), "instance", "seed")
             .groupBy("pattern", "instance").agg(F.min("seed").alias("seed")))
    seeds = phrases.filter("seed IS NOT NULL").groupBy("instance").agg(F.min("seed").alias("kind")).checkpoint()
    seeded = (edges.filter("seed IS NOT NULL").groupBy("pattern", F.col("seed").alias("kind"))
              .agg(F.count(F.lit(1)).alias("support")).checkpoint())
    kinds = seeded.filter(F.col("support") >= min_support).select("pattern", "kind")
    confidence, n_kinds = kinds.withColumn("confidence", F.lit(0.0)), kinds.count()
    folder = f"{ensure_checkpoint_dir(phrases.sparkSession)}/patterns-{uuid.uuid4().hex}"
    while n_kinds:
        graph = (edges.join(confidence.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "instance")
                 .checkpoint())
        confidence = _settled(graph, seeds, confidence, rounds)
        accepted = (graph.join(confidence.filter(F.col("confidence") >= threshold), "pattern").select("instance", "kind")
                    .filter(_may_be(F.col("instance"), F.col("kind"))).distinct()
                    .join(seeds.select("instance"), "instance", "left_anti"))
        added = edges.join(accepted, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("more"))
        wider = written(seeded.join(added, ["pattern", "kind"], "full_outer")
                        .filter(F.coalesce("support", F.lit(0)) + F.coalesce("more", F.lit(0)) >= min_support)
                        .select("pattern", "kind").join(confidence, ["pattern", "kind"], "full_outer")
                        .select("pattern", "kind", F.coalesce("confidence", F.lit(0.0)).alias("confidence")),
                        f"{folder}/{n_kinds}")
        if (n := wider.count()) == n_kinds:
            break
        confidence, n_kinds = wider, n
    return confidence


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_support: int = MIN_SUPPORT,
                  threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: ``doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans``; ``spans`` lists base spans and discovered ones
    (``found_<kind>``) as ``kind:start:end`` by start, then kind.

    Null and empty texts have no spans.  Repeated rows and null ids give one
    row each; an empty table gives no rows;
    other columns are ignored.  At equal starts the base kinds come first, in
    their order.  A phrase with a digit or ``@`` is only discovered when it
    holds at least three such characters, or as an address an ``@``, and overlaps no base span.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("_tm_text"))[1]
    found = find_matches(rows, "_tm_text").checkpoint()
    phrases = _phrases(found).checkpoint()
    confident = score_patterns(phrases, min_support=min_support, threshold=threshold, rounds=rounds).filter(
        F.col("confidence") >= threshold)
    added = (phrases.filter("seed IS NULL")
             .select("_tm_row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
             .join(confident, "pattern").filter(_may_be(F.col("instance"), F.col("kind")))
             .select("_tm_row", F.concat(F.lit("found_"), "kind").alias("kind"), "start", "end").distinct())
    spans = found.filter("kind <> 'phrase'").select("_tm_row", "kind", "start", "end").unionByName(added)
    rank = F.array_position(F.array(*(F.lit(k) for k in BASE_KINDS)), F.col("kind"))
    rank = F.when(rank == 0, len(BASE_KINDS) + 1).otherwise(rank)
    is_base = F.col("kind").isin(*BASE_KINDS)
    item = F.struct("start", rank.alias("rank"), "kind", "end")

    def listing(column: str) -> Column:
        return F.concat_ws(",", F.transform(F.array_sort(column), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    per_row = spans.groupBy("_tm_row").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE_KINDS),
        F.collect_list(F.when(is_base, item)).alias("base"), F.collect_list(item).alias("all"))
    return (rows.select("_tm_row", "doc_id").join(per_row, "_tm_row", "left")
            .select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
                    hex_digest(F.coalesce(listing("base"), F.lit(""))).alias("base_sha256"),
                    F.coalesce(listing("all"), F.lit("")).alias("spans")))


def op5_personal_data(spark, sf_dir):
    """All of ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))
