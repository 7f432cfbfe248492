"""Exact substring dedup by hashing lines and the sentences in them.

Texts are cut at line ends, after sentence ends and, inside longer sentences, after
words that their own hash picks (one in twelve, at least six words on). So a passage
that runs into its neighbours at both ends, or that is one long sentence, is cut at
the same places wherever it stands, but for some words at its ends. Each unit is normalised
(lower case, white space as one space, signs around it dropped) and digested to
128 bits; digests are grouped over the whole corpus. The occurrence with the
smallest (doc_id, offset) stays; every later one is marked. Marked units that
follow each other in a document make a passage; passages of at least
``min_words`` words are removed, and their places in the original text are kept,
in code points. Sentences matter because passages are often pasted into the
middle of a line; the least length keeps short phrases that recur by chance.
Lines that are repeated as a whole can be removed whatever their length.

In scripts without spaces a sentence mark ends a unit without white space after
it, and two characters count as a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, table, unused

UNIT = re.compile(r"[^\n.!?…。！？]*(?:[.!?…]+(?![\s.!?…。！？]|\Z)[^\n.!?…。！？]*)*[.!?…。！？]*[^\S\n]*\n?")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WORD = re.compile(r"\S+")
LONG, LEAST, EVERY = 100, 6, 12  # characters of a sentence that may be cut; words to the next cut; one word in so many
EDGE = " \t\"'“”‘’«»()[]{}-–—*#%&$|.,;:!?…"


class Cuts(dict):
    """Does a sentence end a unit after this word? By the word's own hash, without the signs around it."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= 200_000:
            self.clear()
        cut = xxhash.xxh3_64_intdigest(word.lower().strip(EDGE).encode("utf-8", "surrogatepass")) % EVERY == 0
        if len(word) <= 64:
            self[word] = cut
        return cut


CUTS = Cuts()


def spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of lines, sentences, and pieces of sentences; they cover the text."""
    for m in UNIT.finditer(text):
        start, end = m.span()
        if end - start >= LONG:
            places = [(w.start(), w.end()) for w in WORD.finditer(text, start, end)]
            since = 0
            for (a, b), (nxt, _) in zip(places, places[1:]):
                since += 1
                if since >= LEAST and CUTS[text[a:b]]:
                    yield start, nxt
                    start, since = nxt, 0
        if end > start:
            yield start, end


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit with at least one word."""
    out = []
    text = text or ""
    for start, end in spans(text):
        words = text[start:end].lower().split()
        plain = " ".join(words).strip(EDGE)
        if plain:
            count = len(words) if plain.isascii() else max(len(words), len(UNSPACED.findall(plain)) // 2)
            out.append((start, end, count, xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))))
        elif out and out[-1][1] == start and text[start - 1] != "\n":  # signs at the end of a line go with its last words
            out[-1] = (out[-1][0], end, *out[-1][2:])
    return out


def lines_of(text: str | None, cuts: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """(start, 64-bit digest) of the line that each of the text's ``units`` is in; it is asked for repeated units only."""
    out, upto, line = [], -1, (0, 0)
    for start, *_ in cuts:
        if start >= upto:
            begin = text.rfind("\n", 0, start) + 1
            upto = text.find("\n", start) + 1 or len(text)
            plain = " ".join(text[begin:upto].lower().split()).strip(EDGE)
            line = begin, xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)
        out.append(line)
    return out


def repeated(spark: SparkSession, docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", whole_lines: bool = False) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id, first_start): one row per passage to remove.

    ``first_doc_id`` and ``first_start`` place the kept occurrence of the passage's
    first unit. With ``whole_lines``, every later occurrence of a whole line goes,
    also below ``min_words``. Defined results: rows with a null id take no part; null and empty
    texts have no units; rows that repeat an id are one document, in which equal
    places are the same occurrence; an empty table gives an empty result; other
    columns are not read.
    """
    scratch = Scratch(spark, "lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    us = units(t)
                    rows += [(d, n, *u, *line) for n, (u, line) in enumerate(zip(us, lines_of(t, us) if whole_lines else [(None, None)] * len(us)))]
                columns = list(zip(*rows)) or [()] * 8
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc_id", "nth", "start", "end", "words", "digest", "line_start", "line"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    cuts = scratch.save(own.mapInArrow(cut, "doc_id long, nth int, start int, end int, words int, digest binary, line_start int, line long"), "units")
    firsts = cuts.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))
    later = cuts.join(scratch.save(firsts, "firsts"), "digest").where("doc_id <> first_doc_id or start <> first_start").drop("digest")
    whole = F.lit(False)
    if whole_lines:
        place = F.struct("doc_id", "line_start")
        kept = cuts.groupBy("line").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept <> last").select("line", "kept")
        later = later.join(scratch.save(kept, "lines"), "line", "left")
        whole = F.coalesce(place != F.col("kept"), F.lit(False))
    # one exchange by document, for rows that repeat an id and for the runs below
    columns = ("doc_id", "nth", "start", "end", "words", "first_doc_id", "first_start")
    later = later.select(*columns, whole.alias("whole")).repartition("doc_id").distinct()
    # units of one document that follow each other keep the same difference
    order = Window.partitionBy("doc_id").orderBy("nth", "start")
    runs = later.withColumn("run", F.col("nth") - F.row_number().over(order))
    total = F.sum("words").over(Window.partitionBy("doc_id", "run"))
    runs = runs.withColumn("total", total).where((F.col("total") >= min_words) | F.col("whole")).withColumn("run", F.col("nth") - F.row_number().over(order))
    spans = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min(F.struct("nth", "first_doc_id", "first_start")).alias("f"))
    return spans.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words", F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_start").cast("long").alias("first_start"))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of its texts, and ``removed``: their places in the original text.

    Defined results: rows without passages, null texts and null ids stay as they are,
    with a null ``removed``; rows that repeat an id all lose its passages; an empty table
    gives an empty result; a column named ``removed`` is replaced, others are kept.
    """
    name = unused(docs.columns, "id_")
    lists = spans.groupBy(F.col("doc_id").alias(name)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))  # as long as a document
    joined = docs.drop("removed").join(lists, F.col(id_col).cast("long") == F.col(name), "left").drop(name)
    text = F.col(text_col)
    state = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")), state, lambda s, r: F.struct(F.concat(s["kept"], F.substring(text, s["at"].cast("int") + 1, (r["start"] - s["at"]).cast("int"))).alias("kept"), r["end"].alias("at")))
    rest = F.substring(text, done["at"].cast("int") + 1, F.char_length(text))
    return joined.withColumn(text_col, F.when(F.col("removed").isNull(), text).otherwise(F.concat(done["kept"], rest)))


def op9_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark, table(spark, sf_dir, "documents"))
