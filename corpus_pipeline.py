"""A training-data pipeline over ``documents``: five stages, each by one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that it keeps, with the columns of ``documents``; the last
one returns packed pieces. ``run`` writes each stage's result below the shared
folder and reads it back as the next one's documents.

Defined results: stages take whatever the operators take (nulls in any column,
empty and very long texts, repeated rows, empty tables); columns beyond those of
``documents`` are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import mixing, packing, pii, quality, simhash
from chronofold.llm.common import Scratch, table

#: Pieces of text whose ids a worker of the last stage remembers: a JVM that has done the stages before leaves it less memory.
REMEMBERED = 200_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones draws."""
    return quality.resample(spark, docs, table(spark, sf_dir, "labels")).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on shingles of five words: that with the smallest id."""
    return simhash.deduplicate(spark, docs, words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` as the text now has."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.char_length("text").cast(done.schema["n_chars"].dataType)) if "n_chars" in done.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources interleave at their target weights.

    Written, the order is that of the files' names and of the rows in them.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return mixing.mix(spark, docs, prefix=prefix).orderBy(f"{prefix}slot", f"{prefix}place").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequences and offsets; sequences are numbered in the mixed order.

    That order is read from the files' names and rows; documents that are in no files have none.
    """
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), in_file_order=packing.in_files(docs), remembered=REMEMBERED)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Hashed n-gram models, fingerprints and the random field are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
