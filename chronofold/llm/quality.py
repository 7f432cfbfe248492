"""Quality selection by importance resampling.

Two generative models over hashed n-grams are counted: one over labelled good
documents (the target), one over all documents (the raw corpus). A document's
log weight is the log ratio of its probabilities under the two, as of a passage of
``passage`` n-grams: their mean, times that number. The n-grams of a text hang
together, and so do the errors of models counted from few labelled texts: plain sums
let these errors grow with length and reject long clean texts. Documents are drawn without replacement in proportion to their
weights by Gumbel top-k: each log weight gets Gumbel noise from a hash of the
document's id, and the k largest are kept.

The features are word unigrams, word bigrams, and trigrams of word shapes with a
mark on words that repeat their predecessor; each has a table of its own. Shapes
make the ratio hold for words that neither model has seen. k may be given; else it
is the number of documents whose weight reaches the point that best separates
labelled rows which the target model has not seen. The labelled rows are a bounded
sample, one half for the model and one for that point; everything else is counted
over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.common import REMEMBERED, Scratch, bounded, table, tidy, unused

BUCKETS = 1 << 13
WORDS_KEPT = 250_000
PASSAGE = 50
TABLES = 3
SHAPES = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "XX"), (re.compile(r"[0-9]+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def shape(word: str) -> str:
    """A word's shape: runs of letters, capitals, digits and signs shortened."""
    for pattern, by in SHAPES:
        word = pattern.sub(by, word)
    return word


class Words(dict):
    """Per word: hash of its lower-case form (32 bits) and of its shape (16 bits), in one integer. Long words are not kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 16 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) & 0xFFFF
        if len(word) <= 64:
            self[word] = code
        return code


WORDS = Words()
REMEMBERED["words"] = WORDS.clear


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket number, which text) of all n-grams of whole texts, with repeats; null is an empty text."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.values.dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    there = np.array([w != "" for w in words], dtype=bool)[coded.indices.to_numpy()]
    codes, doc = codes[there], doc[there]
    h, s = codes >> np.uint64(16), codes & np.uint64(0xFFFF)
    low, mul = np.uint64(BUCKETS - 1), np.uint64(0x9E3779B97F4A7C15)

    def mixed(x: np.ndarray) -> np.ndarray:
        return ((x * mul) >> np.uint64(40)) & low

    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]  # in one text
    pairs = mixed(h[:-1] * np.uint64(0x100000001B3) + h[1:])
    again = np.zeros(len(h), dtype=np.uint64)
    again[1:] = (h[1:] == h[:-1]) & two
    s = s * np.uint64(2) + again
    threes = mixed((s[:-2] * np.uint64(1 << 17) + s[1:-1]) * np.uint64(1 << 17) + s[2:])
    at = np.concatenate([h & low, pairs[two] + np.uint64(BUCKETS), threes[three] + np.uint64(2 * BUCKETS)]).astype(np.int64)
    return at, np.concatenate([doc, doc[:-1][two], doc[:-2][three]])


def label_sample(labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, good, held): at most ``fit_rows`` rows of either label, picked by a hash of the id; held out are half of them."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") >= 1).cast("int").alias("good"))
    order = F.xxhash64("doc_id")
    good, bad = (one.where(F.col("good") == g).orderBy(order, "doc_id").limit(fit_rows) for g in (1, 0))
    return good.union(bad).withColumn("held", F.xxhash64(F.lit("held"), "doc_id") % 2 == 0)


def fit(docs: DataFrame, sample: DataFrame, text_col: str = "text", id_col: str = "doc_id", trust: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw probability for every bucket of the three tables.

    The target's counts are joined by ``trust`` times as many drawn from the raw
    model: where the target says little, the ratio stays near 1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(TABLES * BUCKETS, dtype=np.int64), np.zeros(TABLES * BUCKETS, dtype=np.int64)
        for b in batches:
            for part in bounded(b, 0):
                at, doc = features(part.column(0))
                raw += np.bincount(at, minlength=TABLES * BUCKETS)
                good = pc.fill_null(part.column(1), 0).to_numpy(zero_copy_only=False) == 1
                if good.any():
                    target += np.bincount(at[good[doc]], minlength=TABLES * BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    # the sample's size is a parameter, so it may be broadcast
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left").select("text", F.when(~F.col("held"), F.col("good")).alias("good"))
    sums = marked.mapInArrow(tidy(count, "words"), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()  # one row per bucket
    raw, target = np.zeros(TABLES * BUCKETS), np.zeros(TABLES * BUCKETS)
    for at, r, t in sums:
        raw[at], target[at] = r, t
    raw, target = raw.reshape(TABLES, BUCKETS), target.reshape(TABLES, BUCKETS)
    if not target.any():
        return np.zeros(TABLES * BUCKETS)
    seen = raw > 0
    raw = np.where(seen, raw, 1) / raw.sum(axis=1, keepdims=True).clip(1)
    total = target.sum(axis=1, keepdims=True)
    ratio = (target + trust * total * raw) / ((1 + trust) * total.clip(1) * raw)
    return np.where(seen & (total > 0), np.log(ratio.clip(1e-9)), 0.0).ravel()


def log_weights(docs: DataFrame, weights: np.ndarray, text_col: str, to: str, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with each text's log importance weight in column ``to``: 0 for a text without words."""
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in bounded(b, at_text):
                at, doc = features(part.column(at_text))
                n = np.bincount(doc, minlength=part.num_rows)
                w = passage * np.bincount(doc, weights=weights[at], minlength=part.num_rows) / n.clip(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w)], names=[*part.schema.names, to])

    return docs.mapInArrow(tidy(run, "words"), T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def separation(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight that best parts good from bad rows (sum of both error rates), in the middle of its gap."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()  # good rows below the cut
    kept = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()  # bad rows above it
    at = int(np.argmin(lost + kept))
    return -np.inf if at == 0 else np.inf if at == len(w) else float((w[at - 1] + w[at]) / 2)


def gumbel(*by: Column, seed: int = 42) -> Column:
    """Standard Gumbel noise from a hash, so that a task run twice draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The exact kth largest value, by histograms of 16 bits at a time; None for k = 0 or beyond the rows."""
    if k <= 0:
        return None
    low, high = -float("inf"), float("inf")
    bounds = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if bounds[2] < k:
        return None
    low, high = bounds[0], bounds[1]
    above = 0
    while low < high:
        step = (high - low) / 4096
        if not (step > 0 and low + step > low and high - step < high):
            # only a few neighbouring doubles are left
            rest = keys.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).collect()
            for value, n in rest:
                above += n
                if above >= k:
                    return value
        bucket = F.least(F.lit(4095), F.floor((F.col(column) - low) / step))
        found = keys.where(F.col(column).between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()  # 4096 rows at most
        for r in sorted(found, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return low


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, k: int | None = None, fit_rows: int = 20_000, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, passage: int = PASSAGE) -> DataFrame:
    """The kept rows of ``docs``: its columns (or ``columns``) with ``log_weight`` and ``gumbel_key``.

    ``k`` rows are drawn (all, if there are fewer); without it, as many as reach the
    weight that separates the labelled rows. Defined results: null and empty texts
    weigh 0 in the log (both models give them probability 1) and are drawn by that;
    rows with null ids are judged by their text; rows with equal keys at the cut stay
    together; without ``k`` and without good labels, or without bad ones, nothing is
    rejected; an empty table gives an empty result; columns of ``docs`` named like the
    added ones are replaced when ``columns`` is not given. ``docs`` is read two times, and
    once more with the result if that has the texts.
    """
    scratch = Scratch(spark, "quality")
    sample = scratch.save(label_sample(labels, fit_rows), "labels")
    weights = fit(docs, sample, text_col, id_col)
    kept = [c for c in (columns or docs.columns) if c not in ("log_weight", "gumbel_key")]
    inside, own_id = unused([*docs.columns, "log_weight", "gumbel_key"], "text_"), unused([*docs.columns, "log_weight", "gumbel_key"], "id_")
    own = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias(inside), F.col(id_col).cast("long").alias(own_id))
    key = F.col("log_weight") + gumbel(F.col(own_id), seed=seed)
    rows = log_weights(own, weights, inside, "log_weight", passage).withColumn("gumbel_key", key).drop(inside)
    if text_col in kept:  # texts aren't written once more: each is scored again, with the same result, when the rows are read
        alone = log_weights(own.select(inside, own_id), weights, inside, "log_weight", passage)
        scored = scratch.save(alone.withColumn("gumbel_key", key).drop(inside), "scored")
    else:
        rows = scored = scratch.save(rows, "scored")
    if k is None:
        held = scored.select(F.col(own_id).alias("doc_id"), "log_weight").join(F.broadcast(sample.where("held or good = 0")), "doc_id")
        known = held.groupBy("doc_id").agg(F.avg("log_weight").alias("w"), F.min("good").alias("good")).select("w", "good").toPandas()  # one row a labelled id of a bounded sample
        cut = separation(known["w"].to_numpy(float), known["good"].to_numpy(int) == 1)
        k = scored.where(F.col("log_weight") >= cut).count()
    elif scored.count() <= k:
        return rows.drop(own_id)
    least = kth_largest(scored.select("gumbel_key"), "gumbel_key", k)
    return rows.where(F.lit(False) if least is None else F.col("gumbel_key") >= least).drop(own_id)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
