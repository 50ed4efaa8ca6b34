"""Language identification by Bayesian evidence fusion.

The evidence of a document: its text, by hashed byte trigrams under a smoothed model of
each language, tempered as neighbouring trigrams aren't independent; the language its
markup declares; the suffix of its address; and its host. How far declarations and
suffixes can be trusted is counted from the corpus itself, by grouped aggregation
against what the texts say. Host priors are smoothed hierarchically: a host towards its
domain, a domain towards its suffix, a suffix towards the whole corpus, so a host with
few documents says little.

The text model is fitted on at most ``MAX_FIT`` labelled rows and at most half of them, picked
by a hash of the text. A row that it was fitted on doesn't use its declared language as evidence,
and isn't counted in how far declarations are trusted. Host counts are over all rows. Languages
beyond the ``MAX_LANGUAGES`` most frequent are one class of the model, ``other``; documents of
that class aren't accepted, as no language is told.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.scratch import Scratch, small_batches

BUCKETS, MAX_FIT, MAX_LANGUAGES, PARTS = 1 << 16, 40_000, 256, 16
OTHER = "other"
TEMPER, MOST_EVIDENCE = 4.0, 60.0
HOST_WEIGHT, TABLE_WEIGHT = 20.0, 50.0
#: Host priors of at most so many rows are broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 50_000


def trigrams(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of lower-cased texts (white space and ASCII marks and digits
    are one blank), and the n+1 bounds of each text's. Trigrams don't cross texts."""
    folded = np.arange(256, dtype=np.uint32)
    folded[65:91] += 32
    folded[:65] = folded[91:97] = folded[123:128] = 32
    codes = folded[raw]
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    grams = codes[:-2] | codes[1:-1] << np.uint32(8) | codes[2:] << np.uint32(16)
    counts = np.maximum(np.diff(ends) - 2, 0)
    owner, place = bytewise.ragged(counts)
    grams = grams[ends[:-1][owner] + place]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    letter = ((grams & np.uint32(0xFF)) != 32) | ((grams >> np.uint32(8) & np.uint32(0xFF)) != 32)  # not "blank blank x"
    kept = np.concatenate([[0], np.cumsum(letter)])
    return ((grams[letter] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), kept[bounds]


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (languages, BUCKETS): log probabilities
    fitted_below: int = 0  # rows whose hash is below this share of SHARES were fitted on

    def column(self):
        """A column function: text to the tempered log likelihood of each language; empty
        for a text without letters."""
        table = np.ascontiguousarray(self.table.T)

        @F.arrow_udf("array<double>")
        def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bytewise.claim("langid")
            for batch in texts:
                rows, counts = [], []
                for piece in bytewise.pieces(batch, 1 << 18):
                    buckets, bounds = trigrams(*bytewise.buffers(piece))
                    sums = np.zeros((len(buckets) + 1, table.shape[1]))
                    np.cumsum(table[buckets], axis=0, out=sums[1:])
                    n = np.diff(bounds)
                    mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)[:, None]
                    evidence = mean * np.minimum(n / TEMPER, MOST_EVIDENCE)[:, None]
                    rows.append(evidence[n > 0])
                    counts.append(np.where(n > 0, table.shape[1], 0))
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).ravel()))
            bytewise.trim()

        return of


SHARES = 1 << 20


def _draw(text: Column) -> Column:
    return F.pmod(F.xxhash64(text, F.lit("fit")), F.lit(SHARES))


def fit_text(rows: DataFrame) -> TextModel:
    """``rows``: (text, language), labelled. Languages beyond the MAX_LANGUAGES most
    frequent are the class OTHER."""
    rows = rows.where("text is not null and language is not null")
    counts = rows.groupBy("language").count()
    top = counts.orderBy(F.desc("count"), "language").limit(MAX_LANGUAGES).collect()
    languages = sorted(r.language for r in top)
    if not languages:
        return TextModel(["und"], np.full((1, BUCKETS), -np.log(BUCKETS), np.float32))
    total = counts.agg(F.sum("count")).first()[0]
    if total > sum(r["count"] for r in top):
        languages = [x for x in languages if x != OTHER] + [OTHER]
    below = int(min(0.5, MAX_FIT / max(1, total)) * SHARES)
    if total < 2 * len(languages) * 10:  # too few rows to leave half of them out
        below = SHARES
    picked = rows.where(_draw(F.col("text")) < below)
    place, rest = {x: i for i, x in enumerate(languages)}, len(languages) - 1 if languages[-1] == OTHER else -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytewise.claim("langid")
        sums = np.zeros((len(languages), BUCKETS))
        for batch in batches:
            which = np.array([place.get(x, rest) for x in batch.column(1).to_pylist()], np.int64)
            for piece, own in _with(batch.column(0), which):
                buckets, bounds = trigrams(*bytewise.buffers(piece))
                owner = np.repeat(own, np.diff(bounds))
                for k in np.unique(own[own >= 0]):
                    sums[k] += np.bincount(buckets[owner == k], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    found = picked.select("text", "language").coalesce(PARTS).mapInArrow(count, "sums binary").toLocalIterator()
    sums = np.zeros((len(languages), BUCKETS))
    for r in found:
        sums += np.frombuffer(r.sums, np.float32).reshape(sums.shape)
    smooth = sums + 0.5 * sums.sum(0) / max(1.0, sums.sum()) * BUCKETS * 0.01 + 0.01
    return TextModel(languages, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32), below)


def _with(texts: pa.Array, other: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    at = 0
    for piece in bytewise.pieces(texts):
        yield piece, other[at : at + len(piece)]
        at += len(piece)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z), without port; empty where the address has none."""
    return F.regexp_replace(F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r":\d*$", "")


def _counts(languages: list[str]) -> list[Column]:
    return [F.sum((F.col("best") == i).cast("double")).alias(f"n{i}") for i in range(len(languages))]


def _softmax(scores: Column) -> Column:
    parts = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, text_col: str = "text", declared_col: str | None = None, url_col: str | None = None, host_col: str | None = None, model: TextModel | None = None, least: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``lang_id``, ``lang_score`` and ``lang_accepted`` (in place of columns of
    those names). A document is accepted if its text holds letters and the best language's
    posterior is at least ``least``; one of a language beyond the most frequent is accepted as ``OTHER``.

    Without ``model``, one is fitted on the declared languages. Null or empty evidence of
    any kind counts for nothing; a null or empty text, or one without letters, gets the
    language its other evidence favours and isn't accepted. Null ids and repeated rows
    pass through. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "langid")
    text = F.coalesce(F.col(text_col), F.lit(""))
    declared = F.coalesce(F.lower(F.substring_index(F.col(declared_col), "-", 1)), F.lit("")) if declared_col else F.lit("")
    host = host_of(F.col(url_col)) if url_col else F.coalesce(F.col(host_col), F.lit("")) if host_col else F.lit("")
    if model is None:
        model = fit_text(docs.select(text.alias("text"), F.nullif(declared, F.lit("")).alias("language")))
    languages, k = model.languages, len(model.languages)
    keep = [c for c in docs.columns if c not in ("lang_id", "lang_score", "lang_accepted")]
    fitted = (_draw(text) < model.fitted_below) if 0 < model.fitted_below < SHARES else F.lit(False)
    told = docs.select(F.struct(*keep).alias("__row"), F.when(~fitted, declared).otherwise("").alias("__declared"), host.alias("__host"), model.column()(text).alias("__ll"))
    best = F.when(F.size("__ll") > 0, F.array_position("__ll", F.array_max("__ll")) - 1).otherwise(-1).alias("best")
    seen = told.select(best, "__declared", "__host").groupBy("__host", "__declared", "best").agg(F.count("*").alias("m"))
    seen = scratch.keep(seen, "seen")
    votes = [F.sum(F.when(F.col("best") == i, F.col("m")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(k)]
    hosts = seen.groupBy("__host").agg(*votes)
    total = seen.agg(*votes).first()
    overall = np.array([x or 0.0 for x in total]) + 1.0
    overall /= overall.sum()
    suffix_rows = hosts.groupBy(suffix_of(F.col("__host")).alias("key")).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
    domain_rows = hosts.groupBy(domain_of(F.col("__host")).alias("domain")).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
    declared_rows = seen.where("__declared != ''").groupBy(F.col("__declared").alias("key")).agg(*votes)

    def smooth(prefix: str, parent: list[Column]) -> list[Column]:
        size = sum((F.col(f"{prefix}{i}") for i in range(k)), F.lit(0.0))
        return [(F.col(f"{prefix}{i}") + HOST_WEIGHT * parent[i]) / (size + HOST_WEIGHT) for i in range(k)]

    whole = [F.lit(float(x)) for x in overall]
    suffix_prior = suffix_rows.select("key", *[c.alias(f"s{i}") for i, c in enumerate(smooth("n", whole))])
    domains = domain_rows.withColumn("key", suffix_of(F.col("domain"))).join(suffix_prior, "key", "left")
    domain_prior = domains.select("domain", *[c.alias(f"d{i}") for i, c in enumerate(smooth("n", [F.coalesce(F.col(f"s{i}"), whole[i]) for i in range(k)]))])
    host_prior = hosts.withColumn("domain", domain_of(F.col("__host"))).join(domain_prior, "domain")
    host_prior = host_prior.select("__host", F.array(*[F.log(c) for c in smooth("n", [F.col(f"d{i}") for i in range(k)])]).alias("__prior"))
    # P(declared | language) over P(declared): how much a declaration speaks for a language
    size = sum((F.col(f"n{i}") for i in range(k)), F.lit(0.0))
    trust = declared_rows.select(F.col("key").alias("__declared"), F.array(*[F.log((F.col(f"n{i}") + TABLE_WEIGHT * float(x)) / (size + TABLE_WEIGHT)) - float(np.log(x)) for i, x in enumerate(overall)]).alias("__says"))
    trust = scratch.keep(trust, "trust")
    if trust.count() <= BROADCAST_ROWS:
        trust = F.broadcast(trust)
    nothing = F.array(*[F.lit(0.0)] * k)
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        host_prior = F.broadcast(host_prior)
    joined = told.join(host_prior, "__host", "left").join(trust, "__declared", "left")
    says = F.coalesce("__says", nothing)
    prior = F.coalesce("__prior", F.array(*[F.log(c) for c in whole]))
    ll = F.when(F.size("__ll") > 0, F.col("__ll")).otherwise(nothing)
    scores = F.zip_with(F.zip_with(prior, says, lambda a, b: a + b), ll, lambda a, b: a + b)
    out = joined.select("__row", (F.size("__ll") > 0).alias("__letters"), _softmax(scores).alias("__p"))
    top = F.array_max("__p")
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("__p", top).cast("int"))
    return out.select("__row.*", name.alias("lang_id"), top.alias("lang_score"), (F.col("__letters") & (top >= least)).alias("lang_accepted"))
