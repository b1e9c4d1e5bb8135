"""Language identification by Bayesian evidence fusion.

For each row the log posterior of a language is the sum of

* the text's log likelihood under hashed character trigrams of that language,
  tempered to ``TEXT_WEIGHT * sqrt(trigrams)`` independent trigrams, because
  neighbouring trigrams repeat each other's evidence;
* the likelihood of the declared language, if one is declared;
* the likelihood of the address suffix, if it belongs to a language;
* the log prior of its host.  Host, domain, suffix and the whole table each
  count the text posteriors of their rows, by grouped aggregation, and each
  level is smoothed by the one above; a row's own text is taken out first.

``und`` competes as one more language whose trigrams are all equally likely; a
row that goes to it, or to no language with at least half the posterior, is
rejected.  The trigram model is fitted on a bounded sample of labelled rows
(about ``FIT_ROWS`` a language); everything else covers all rows.

Scale: the text is read once to fit (sampled rows only are processed) and once
to score; after that a row is its id and two short arrays.  A hot host is
collapsed to one row before its shuffle, and the join that brings the prior
back is one Spark can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.llm.common import keyed, prepare, table, without_rows
from tastemap.llm.shingles import mix

BUCKETS = 1 << 15
FIT_ROWS = 3000
#: The model holds every label.  It is broadcast, and a worker holds it besides its rows, so beyond this size (2,048 labels) it is an error.
MODEL_BYTES = 256 << 20
TEXT_WEIGHT = 4.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
SMOOTHING = 10.0
UNKNOWN = "und"
#: Country suffixes and the language mostly written there.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "ch": "de", "li": "de", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es",
    "pe": "es", "fr": "fr", "ca": "en", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it",
    "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv",
}


def trigram_buckets(text: str) -> np.ndarray:
    """Hash buckets of the trigrams around each letter; anything else counts as a blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = ((codes >= 0x61) & (codes <= 0x7A)) | (codes >= 0xC0)
    codes = np.where(letter, codes, np.uint64(0x20))
    middle = np.flatnonzero(letter[1:-1]) + 1
    key = codes[middle - 1] << np.uint64(42) | codes[middle] << np.uint64(21) | codes[middle + 1]
    return (mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Model:
    """Log probabilities per bucket; the last column is ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        self.logs = np.empty((BUCKETS, len(languages) + 1), np.float32)
        for i, row in enumerate(counts):  # one language at a time
            smooth = row.astype(np.float64) + 0.5
            self.logs[:, i] = np.log(smooth / smooth.sum())
        self.logs[:, -1] = -math.log(BUCKETS)

    def evidence(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams and tempered log likelihoods."""
        buckets = trigram_buckets(text or "")
        if not len(buckets):
            return 0, np.zeros(len(self.languages))
        return len(buckets), self.logs[buckets].sum(axis=0, dtype=np.float64) * (TEXT_WEIGHT / math.sqrt(len(buckets)))


def fit(labelled: DataFrame, *, text: str, label: str, row_id: str, fit_rows: int = FIT_ROWS) -> Model:
    """The trigram model of the labelled rows.

    At most about ``fit_rows`` rows a language are used: those whose hash of id
    and text falls under the share that leaves that many.  Labels count in lower
    case.  Rows with a null label or text, or labelled ``und``, are left out;
    without any labelled row only ``und`` remains.
    """
    rows = labelled.select(F.lower(F.col(label).cast("string")).alias("label"), F.col(text).alias("text"),
                           F.col(row_id).alias("id")).filter(f"label <> '{UNKNOWN}' AND text IS NOT NULL")
    sizes = sorted((r["label"], r["count"]) for r in rows.groupBy("label").count().collect())
    languages = [label for label, _ in sizes]
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    if len(languages) * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} labels are too many for one broadcast model")
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    shares = labelled.sparkSession.createDataFrame(
        [(label, i, int(min(1.0, fit_rows / n) * (1 << 30))) for i, (label, n) in enumerate(sizes)],
        "label string, rank int, share long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, value in zip(batch.column("rank").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen = np.bincount(trigram_buckets(value), minlength=BUCKETS)
                totals[lang] = totals[lang] + seen if lang in totals else seen
        for lang, seen in totals.items():
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())],
                names=["rank", "bucket", "n"])

    counted = (rows.join(F.broadcast(shares), "label").filter(place < F.col("share")).select("rank", "text")
               .mapInArrow(run, "rank int, bucket int, n long")
               .groupBy("rank", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages * BUCKETS rows at most
    counts = np.zeros((len(languages), BUCKETS), np.float32)  # at most MODEL_BYTES
    counts[counted["rank"].to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy(float)
    return Model(languages, counts)


def _text_evidence(rows: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``trigrams``, ``ll`` and ``p``, the posterior of the text alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*(rows.schema[c] for c in keep), T.StructField("trigrams", T.LongType()),
                        T.StructField("ll", T.ArrayType(T.DoubleType())),
                        T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, ll = zip(*map(known.evidence, batch.column(text).to_pylist()), strict=True) \
                if batch.num_rows else ((), ())
            ll = np.array(ll).reshape(batch.num_rows, len(known.languages))
            p = np.exp(ll - ll.max(axis=1, keepdims=True))
            p = p / p.sum(axis=1, keepdims=True) * (np.array(n)[:, None] > 0)
            ends = pa.array(np.arange(batch.num_rows + 1) * len(known.languages), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(ll.ravel())),
                 pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=[f.name for f in out])

    return rows.select(*keep, text).mapInArrow(run, out)


def _sums(df: DataFrame, key: str, values: str, n: int, name: str) -> DataFrame:
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *(F.sum(F.col(values)[i]).alias(f"s{i}") for i in range(n)))
    return grouped.select(key, F.array(*(f"s{i}" for i in range(n))).alias(name))


def _smoothed(counts: Column, own: Column, above: Column, weight: float = SMOOTHING) -> Column:
    """``(counts - own + weight * above) / (their sum)``, place by place."""
    left = F.zip_with(F.coalesce(counts, F.transform(own, lambda _: F.lit(0.0))),
                      own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    total = F.aggregate(left, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(left, above, lambda c, a: (c + weight * a) / total)


def identify(rows: DataFrame, model: Model, *, keep: tuple[str, ...], text: str = "text", declared: str = "declared",
             host: str = "host") -> DataFrame:
    """``keep`` columns with ``lang``, ``posterior``, ``trigrams`` and ``kept``, one row per row.

    ``lang`` is the most probable language (ties: the first in the alphabet,
    ``und`` last) and ``kept`` says that it is not ``und``, has at least half the
    posterior and the text has a letter.  A null, empty or letterless text has
    no text evidence and is rejected with its best guess.  A declared language
    counts without case, and by its first part where the model has no other; a
    null or unknown one, ``und``, or a null host adds no evidence; a host without a dot has no domain
    levels.  Repeated rows are judged alike; an empty table gives no rows.
    """
    prepare(rows.sparkSession)
    size = len(model.languages)
    lower = F.lower(F.col(host))
    said = F.lower(F.trim(F.col(declared).cast("string")))
    known = F.array(*(F.lit(x) for x in model.languages[:-1])) if size > 1 else F.array().cast("array<string>")
    main = F.regexp_extract(said, "^[^-_]*", 0)  # en-US without a label of its own is en
    said = F.when(F.array_contains(known, said), said).when(F.array_contains(known, main), main)
    base = rows.select(*keep, F.col(text).alias("_tm_text"), said.alias("_tm_declared"), lower.alias("_tm_host"))
    scored = _text_evidence(base, model, "_tm_text", [*keep, "_tm_declared", "_tm_host"]).checkpoint()

    hosts = _sums(scored, "_tm_host", "p", size, "of_host").withColumns({
        "_tm_domain": F.when(F.col("_tm_host").contains("."), F.substring_index("_tm_host", ".", -2)),
        "_tm_suffix": F.when(F.col("_tm_host").contains("."), F.substring_index("_tm_host", ".", -1))})
    hosts = hosts.checkpoint()
    domains = _sums(hosts, "_tm_domain", "of_host", size, "of_domain")
    suffixes = _sums(hosts, "_tm_suffix", "of_host", size, "of_suffix")
    everything = scored.agg(*(F.sum(F.col("p")[i]) for i in range(size))).first()
    priors = (hosts.join(domains, "_tm_domain", "left").join(suffixes, "_tm_suffix", "left")
              .select("_tm_host", "_tm_suffix", "of_host", "of_domain", "of_suffix"))
    joined = scored.join(priors, "_tm_host", "left")

    uniform = F.array(*(F.lit(1.0 / size) for _ in range(size)))
    whole = F.array(*(F.lit(float(x or 0.0)) for x in everything))
    own = F.col("p")
    prior = _smoothed(whole, own, uniform, float(size))
    for level in ("of_suffix", "of_domain", "of_host"):
        joined = joined.withColumn("prior", prior)
        prior = _smoothed(F.col(level), own, F.col("prior"))
    joined = joined.withColumn("prior", prior)

    names = F.array(*(F.lit(x) for x in model.languages))
    spoken = F.coalesce(*(F.when(F.col("_tm_suffix") == s, F.lit(x)) for s, x in SUFFIX_LANGUAGE.items()))

    def says(claim: Column, right: float, lang: Column) -> Column:
        """Log likelihood of a claimed language: right for its own, else spread evenly."""
        other = F.lit(math.log((1 - right) / max(1, size - 1)))
        return (F.when(claim.isNull() | ~F.array_contains(names, claim), 0.0)
                .when(lang == claim, math.log(right)).when(lang == UNKNOWN, math.log(1.0 / size)).otherwise(other))

    fused = F.zip_with(F.zip_with(F.col("ll"), F.col("prior"), lambda a, b: a + F.log(b)), names,
                       lambda a, x: a + says(F.col("_tm_declared"), DECLARED_RIGHT, x) + says(spoken, SUFFIX_RIGHT, x))
    joined = joined.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    joined = joined.withColumn("posterior", F.round(1.0 / F.aggregate(
        F.transform("fused", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x), 6))
    lang = F.element_at(names, F.array_position("fused", F.col("top")).cast("int"))
    return joined.select(*keep, lang.alias("lang"), "posterior", "trigrams",
                         ((lang != UNKNOWN) & (F.col("posterior") >= 0.5) & (F.col("trigrams") > 0)).alias("kept"))


def page_rows(pages: DataFrame) -> DataFrame:
    """``page_id, text, declared, host`` of raw pages: declared markup language, address host, visible text."""
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select("page_id", visible.alias("text"), F.when(declared != "", declared).alias("declared"),
                        F.when(host != "", host).alias("host"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text, lang, source``) without the rows whose language is rejected; the declared
    language is ``lang``, the host ``source``, and the model is fitted on the labelled rows themselves.

    Null and empty texts are rejected; a null label or host is no evidence; repeated rows are judged alike;
    an empty table stays empty; all columns come back, whatever their names."""
    numbered, rows, name = keyed(docs, F.col("text"), F.col("lang").alias("declared"), F.col("source").alias("host"))
    model = fit(docs, text="text", label="lang", row_id="doc_id")
    judged = identify(rows, model, keep=("_tm_row",))
    return without_rows(numbered, judged.filter("NOT kept").select("_tm_row").checkpoint(), name)


def op2_language_id(spark, sf_dir):
    """All of ``documents`` and all of ``pages``, in one table of hosts.

    A page's ``doc_id`` is ``-1 - page_id`` and its ``kind`` is ``page``.
    """
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(documents, text="text", label="lang", row_id="doc_id")
    rows = documents.select("doc_id", F.lit("document").alias("kind"), "text", F.col("lang").alias("declared"),
                            F.col("source").alias("host"))
    rows = rows.unionByName(page_rows(pages).select((-1 - F.col("page_id")).alias("doc_id"), F.lit("page").alias("kind"),
                                                    "text", "declared", "host"))
    return identify(rows, model, keep=("doc_id", "kind"))
