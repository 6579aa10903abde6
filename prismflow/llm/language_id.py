"""Language identification by fusing evidence with Bayes' rule.

Text: a naive Bayes model over hashed byte trigrams (letters only; anything else is a gap), trained on a
sample of at most `per_language` labelled documents a language; every whole text is scored. A uniform
model over the trigram slots stands for "no language" (und). As trigrams overlap, their log-likelihood
counts a third. There may be any number of languages; with many, trigrams share slots more, so that the
broadcast model stays within 32 MB up to 8192 of them.

Other evidence is estimated from the whole table by grouped aggregation of the text model's confident
votes: how often a declared (markup) language and an address suffix occur with each language, and the
languages of each host, smoothed towards those of its domain, which are smoothed towards those of all.
A row's own vote is left out of its host's and domain's counts. Posterior ~ text * declared * suffix * host.

Each declared language and suffix counts as itself; those with few votes share what all such have. Tables of
values, hosts and domains are stored before they are joined, so Spark broadcasts one only where it is small,
and may split a hot value where it is not.

Defined results: null, empty or letterless text has no text evidence; where the rest does not settle it
either the language is und and the row is not kept. Missing or odd declared languages and addresses count
as their own value of that evidence. Of languages of equal posterior the first by name is taken, und last.
Null ids and repeated rows give rows like any other; other columns are ignored, whatever their names; an
empty table gives an empty result. Without labelled rows every language is und.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismflow.llm.common import in_batches, materialize, slices, without_rows

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
#: Labelled documents a language that the text model is trained on, at most.
PER_LANGUAGE = 500
#: Values of a declared language or suffix with fewer votes share one likelihood.
FEW_VOTES = 20
#: A vote counts for the other evidence from this text posterior on; strength of smoothing of host priors.
CONFIDENT, STRENGTH = 0.95, 10.0
#: A row is kept if its best language has this posterior.
ACCEPT = 0.5

_GAP = 0
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_HASH = np.random.default_rng(15).integers(0, SLOTS, (3, 256), dtype=np.uint16)


def trigram_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each byte's trigram, of all texts one after another (SLOTS: none), and each text's bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    c = _CLASS[raw]
    slots = np.full(len(c), SLOTS, dtype=np.uint16)
    if len(c) > 2:
        a, b, d = c[:-2], c[1:-1], c[2:]
        slots[:-2] = _HASH[0][a] ^ _HASH[1][b] ^ _HASH[2][d]
        slots[:-2][(a | b | d) == _GAP] = SLOTS
    stops = ends[1:] - ends[0]
    for back in (1, 2):  # trigrams do not reach into the next text
        slots[np.maximum(stops - back, 0)[stops >= back]] = SLOTS
    return slots, np.diff(ends)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of slots: a row for each language, the last for no language."""

    languages: tuple[str, ...]
    logs: np.ndarray
    bits: int = SLOT_BITS


def _slot_bits(languages: int) -> int:
    """Bits of a slot, fewer where languages are many."""
    return max(10, min(SLOT_BITS, 23 - max(1, languages).bit_length()))


def train_text_model(labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """The model of a bounded sample: in each language the per_language rows of least draw, a hash of id, language and text.

    Rows alike in all three count once; null ids and ids that repeat are drawn like any other.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(lang_col).alias("lang")).filter("lang is not null and text is not null")
    rows = rows.select(F.xxhash64("id", "lang", "text").alias("draw"), "lang", "text")
    totals = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("of_lang")), "labels")
    bits = _slot_bits(totals.count())
    # first by a share that leaves about twice as many, so that no language is gathered to be ranked
    part = F.hash("draw").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) / 2.0**32
    few = rows.withColumn("part", part).join(totals, "lang").filter(F.col("part") < 2.0 * per_language / F.col("of_lang"))
    few = few.select("lang", "draw", "part", "text").dropDuplicates(["lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("part", "draw"))
    sample = few.withColumn("place", place).filter(F.col("place") <= per_language)

    none = 1 << bits

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            slots, sizes = trigram_slots(part.column("text"))
            slots = slots >> (SLOT_BITS - bits)  # the last slot stays the last
            langs, which = np.unique(np.array(part.column("lang").to_pylist()), return_inverse=True)
            pair = np.repeat(which, sizes) * (none + 1) + slots
            values, n = np.unique(pair[slots < none], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs[values // (none + 1)].astype(object), pa.string()), pa.array((values % (none + 1)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "slot", "n"])

    found = in_batches(sample.select("lang", "text"), counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # a row per language, of its slots and their counts
    table_of = {r["lang"]: (r["slots"], r["counts"]) for r in found.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts")).toLocalIterator()}
    languages = tuple(sorted(table_of))
    table = np.full((len(languages) + 1, none + 1), 0.5, dtype=np.float32)
    for k, lang in enumerate(languages):
        at, n = table_of[lang]
        table[k, at] += np.array(n, dtype=np.float32)
    table[-1] = 1.0
    table[:, none] = 0
    logs = np.log(np.maximum(table, 1e-30) / table.sum(axis=1, keepdims=True, dtype=np.float64))
    logs[:, none] = 0
    return TextModel(languages, logs.astype(np.float32), bits)


def _decoded(part: pa.RecordBatch) -> pa.Array:
    """Texts, those of pages with their character references filled in."""
    text = part.column("text")
    coded = pc.and_(pc.equal(part.column("kind"), "page"), pc.match_substring(text, "&")).fill_null(False)
    if not pc.any(coded).as_py():
        return text
    return pa.array([unescape(t) if c else t for t, c in zip(text.to_pylist(), coded.to_pylist())], pa.string())


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, shift = model.value.logs, SLOT_BITS - model.value.bits
        for part in slices(batches):
            slots, sizes = trigram_slots(_decoded(part))
            slots >>= shift
            full = sizes > 0
            out = np.zeros((len(sizes), len(logs)))
            if full.any():
                starts = (np.cumsum(sizes) - sizes)[full]
                for k, row in enumerate(logs):
                    out[full, k] = np.add.reduceat(row[slots], starts, dtype=np.float64) / 3
            out -= out.max(axis=1, keepdims=True)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), len(logs)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEYS), flat], names=[*KEYS, "text_log"])

    return run


KEYS = ["kind", "id", "digest", "declared", "suffix", "host", "domain"]


def evidence(rows: DataFrame, kind: str, row_id: Column, text: Column, declared: Column, address: Column, digest: Column | None = None) -> DataFrame:
    """Rows in the shape that identify() takes; address is a URL, a host or any name of an origin.

    A digest, if given, tells rows of one id apart in what identify() returns.
    """
    digest = F.lit(None).cast("binary") if digest is None else digest
    host = F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = rows.select(F.lit(kind).alias("kind"), row_id.cast("long").alias("id"), text.alias("text"), digest.alias("digest"), F.lower(F.trim(F.coalesce(declared, F.lit("")))).alias("d"), host.alias("host"))
    given = lambda c: F.when(c == "", "none").otherwise(c)
    return known.select(
        "kind", "id", "text", "digest",
        given(F.regexp_extract("d", "^([a-z]*)", 1)).alias("declared"),
        F.when(F.instr("host", ".") > 0, given(F.regexp_extract("host", r"\.([a-z]+)$", 1))).otherwise("none").alias("suffix"),
        "host", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1).alias("domain"),
    )


def page_text(html: Column) -> Column:
    """A page's visible text: scripts, styles, comments and tags left out; character references stay, see _decoded()."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def page_language(html: Column) -> Column:
    """The language that a page's markup declares, or the empty string."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def _softmax(logs: Column) -> Column:
    whole = F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(logs)))
    return F.transform(logs, lambda x: F.exp(x - F.array_max(logs)) / whole)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(rows: DataFrame, model: TextModel, accept: float = ACCEPT, strength: float = STRENGTH) -> DataFrame:
    """One row per row of evidence(): kind, id, digest, text_language, language, posterior, kept."""
    names = [*model.languages, "und"]
    n = len(names)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = "kind string, id long, digest binary, declared string, suffix string, host string, domain string, text_log array<double>"
    scored = in_batches(rows, _scored(shared), schema)
    post = _softmax(F.col("text_log"))
    best = F.array_position(F.col("post"), F.array_max("post")).cast("int") - 1
    scored = scored.withColumn("post", post).withColumn("vote", F.when(F.array_max("post") >= CONFIDENT, best)).drop("post")
    scored = materialize(scored, "language-scores")
    none = F.array_repeat(F.lit(0.0), n)

    def votes(frame: DataFrame, *keys: str) -> DataFrame:
        """For each value of keys that has votes, their numbers by language, as `votes`."""
        each = frame.filter("vote is not null").groupBy(*keys, "vote").agg(F.count(F.lit(1)).cast("double").alias("n"))
        by = F.map_from_entries(F.collect_list(F.struct("vote", "n")))
        return each.groupBy(*keys).agg(by.alias("by")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0.0))).alias("votes"))

    sums = np.ones(n)
    for r in scored.filter("vote is not null").groupBy("vote").count().collect():
        sums[r["vote"]] += r["count"]
    overall = F.array(*[F.lit(float(x)) for x in sums / sums.sum()])
    per_language = F.array(*[F.lit(float(x)) for x in sums])
    total_of = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)

    def likelihood(column: str) -> tuple[DataFrame, Column]:
        # log P(value | language), a vote spread over the languages as prior; and the same of all values with few votes
        log = lambda v: F.zip_with(v, per_language, lambda x, s: F.log((x + 0.5) / (s + 20.0)))
        counts = materialize(votes(scored, column), column)
        common = counts.filter(total_of(F.col("votes")) >= FEW_VOTES)
        rare = counts.filter(total_of(F.col("votes")) < FEW_VOTES).select(F.posexplode("votes").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("values")).collect()
        shared = [0.0] * n
        for r in rare:
            shared[r["k"]] = r["v"] / r["values"]
        return materialize(common.select(column, log(F.col("votes")).alias(f"{column}_log")), f"{column}-log"), log(F.array(*[F.lit(float(x)) for x in shared]))

    hosts = materialize(votes(scored, "host", "domain").withColumnRenamed("votes", "host_votes"), "hosts")
    domains = votes(scored, "domain").withColumnRenamed("votes", "domain_votes")
    hosts = materialize(scored.select("host", "domain").distinct().join(hosts, ["host", "domain"], "left").join(domains, "domain", "left").select("host", F.coalesce("host_votes", none).alias("host_votes"), F.coalesce("domain_votes", none).alias("domain_votes")), "priors")
    own = F.array(*[F.when(F.col("vote") == k, 1.0).otherwise(0.0) for k in range(n)])
    less = lambda v: F.zip_with(F.col(v), own, lambda x, o: x - o)
    smooth = lambda v, prior: F.zip_with(v, prior, lambda x, p: (x + strength * p) / (total_of(v) + strength))
    joined = scored.drop("domain").join(hosts, "host")
    for column in ("declared", "suffix"):
        known, other = likelihood(column)
        joined = joined.join(known, column, "left").withColumn(f"{column}_log", F.coalesce(f"{column}_log", other))
    prior = joined.withColumn("d", less("domain_votes")).withColumn("h", less("host_votes")).withColumn("p", smooth(F.col("d"), overall)).withColumn("p", smooth(F.col("h"), F.col("p")))
    logs = _plus(_plus(F.col("text_log"), F.transform("p", lambda x: F.log(x))), _plus(F.col("declared_log"), F.col("suffix_log")))
    fused = prior.withColumn("logs", logs).withColumn("post", _softmax(F.col("logs")))
    named = lambda c: F.get(F.array(*[F.lit(x) for x in names]), F.array_position(c, F.array_max(c)).cast("int") - 1)
    out = fused.select("kind", "id", "digest", named(F.col("text_log")).alias("text_language"), named(F.col("post")).alias("language"), F.round(F.array_max("post"), 6).alias("posterior"))
    return out.withColumn("kept", (F.col("language") != "und") & (F.col("posterior") >= accept))


def document_evidence(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """Documents as evidence: lang is what they declare, source is their host."""
    return evidence(docs, "document", F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), digest)


def _row_digest() -> Column:
    """128 bits of all that a document is judged by: its text, declared language and origin, nulls apart from empty text."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("null")) for c in ("lang", "source", "text")]
    return F.unhex(F.md5(F.concat(*parts)))


def identify_corpus(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents and pages by one model, trained on labelled documents: doc_id or page_id, and the columns of identify()."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = document_evidence(docs).unionByName(evidence(pages, "page", F.col("page_id"), page_text(html), page_language(html), F.col("url")))
    found = identify(rows, train_text_model(docs))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(of("document").alias("doc_id"), of("page").alias("page_id"), "text_language", "language", "posterior", "kept")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is settled; a document is looked up by its id and a digest of its text and evidence.

    Rows alike in these have the same evidence, so they have one verdict.
    """
    found = identify(document_evidence(docs, _row_digest()), train_text_model(docs)).select("id", "digest", "kept")
    found = materialize(found, "verdicts")  # a filter on what is computed here would compute it again and again
    return without_rows(docs, found.filter("not kept").select("id", "digest").distinct(), [F.col("doc_id").cast("long"), _row_digest()])
