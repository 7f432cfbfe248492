"""Best-fit-decreasing packing of token sequences.

Pieces are placed from the longest to the shortest, each in the open bin with the
least room that still holds it; a segment tree over the remaining capacities
finds that bin in logarithmic time. Best fit decreasing depends on lengths alone,
so the plan is made from the histogram of lengths (at most ``capacity`` rows
whatever the corpus holds) and treats runs of equal pieces and of equal bins at
once; it is the plan that placing all pieces of the corpus one by one, in one
place, would give. The pieces are then ranked within their length in parallel and
look up their place by rank.

Where the documents come in an order that matters (``in_file_order``: they are read
from files whose names and rows are in the order of a mix, say), pieces of one
length are ranked in that order, and sequences are numbered by the first of their
pieces in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, bounded, table, tidy
from chronofold.llm.tokens import CACHE_ENTRIES, encoder


class CapacityTree:
    """Which remaining capacities (0..size) have open bins; finds the least one that is large enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += n
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity >= ``need`` with an open bin."""
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit decreasing over ``{length: pieces}``.

    Per length, runs ``(first rank, pieces in a bin, first bin, offset)`` in order
    of rank: piece ``rank`` goes to bin ``first bin + k // n`` at ``offset + k % n *
    length`` with ``k = rank - first rank``.
    """
    tree = CapacityTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first bin, bins)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        out = runs.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    out.append((rank, each, bins, 0))
                    put(capacity - each * length, bins, full)
                if rest:
                    out.append((rank + full * each, rest, bins + full, 0))
                    put(capacity - rest * length, bins + full, 1)
                bins += full + bool(rest)
                break
            first, n = groups[room].pop()
            tree.add(room, -n)
            # the tightest bin stays the tightest until it can't hold another piece of this length
            each = room // length
            used, rest = (n, 0) if left >= n * each else divmod(left, each)
            if used:
                out.append((rank, each, first, capacity - room))
                put(room - each * length, first, used)
            if rest:
                out.append((rank + used * each, rest, first + used, capacity - room))
                put(room - rest * length, first + used, 1)
            put(room, first + used + bool(rest), n - used - bool(rest))
            rank += used * each + rest
            left -= used * each + rest
    return runs


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = "file long, name string, row long"
ROWS, READ = 2000, 4 << 20  # documents that a task gets at once; bytes of text that it cuts at once


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, remembered: int = CACHE_ENTRIES) -> DataFrame:
    """Every document's ids in pieces: its first piece takes the remainder, the others are full.

    ``docs`` has doc_id, text and its place (file, name, row). ``first`` is the row
    of the first document that the task has of the file, ``nth`` counts the pieces
    of one length from there. ``remembered`` bounds the tokenizer's cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, remembered), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        now, first, seen = None, 0, [0] * (capacity + 1)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "file", "name", "row", "first", "nth"]
        for whole in batches:
            for b in bounded(whole, 1, READ):
                rows = []
                for doc_id, ids, file, name, row in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist()), *(b.column(c).to_pylist() for c in (2, 3, 4))):
                    if file is None:  # no order is asked for: any distinct place will do
                        file, name, row = part, "", 0
                    if (file, name) != now:
                        now, first, seen = (file, name), row, [0] * (capacity + 1)
                    ids += end
                    n, start, k = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        rows.append((doc_id, k, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), file, name, row, first, seen[length]))
                        seen[length] += 1
                        start, k = start + length, k + 1
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    return docs.mapInArrow(tidy(run, "tokens"), f"{PIECE}, {PLACE}, first long, nth long")


def file_place() -> list[Column]:
    """Where a row of a table of written files stands: the file's number, its name, the row in it."""
    return [F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0)).alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row")]


def in_files(docs: DataFrame) -> bool:
    """Is ``docs`` read from Parquet files as it is, so that its rows have places in them?"""
    try:
        return bool(docs.select("_metadata.file_name", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def numbered(scratch: Scratch, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with their rank by ``by`` (from 0) as ``number``: sorted files, their rows, and the rows of the files before."""
    scratch.save(rows.orderBy(*by), name)
    files = scratch.spark.read.schema(rows.schema).parquet(scratch.path(name)).select("*", *file_place())
    counts = files.groupBy("file", "name").agg(F.count("*").alias("n"))
    bases = counts.select("file", "name", (F.sum("n").over(Window.orderBy("file", "name")) - F.col("n")).alias("base"))  # one row a file
    return files.join(F.broadcast(bases), ["file", "name"]).withColumn("number", F.col("base") + F.col("row")).drop("file", "name", "row", "base")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", in_file_order: bool = False, remembered: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With ``in_file_order``, ``docs`` is read from written files and sequences are
    numbered in their order. A worker remembers the ids of ``remembered`` pieces of
    text: fewer take less memory and more time. Defined results: null text is an empty one; without
    ``end_id`` an empty text has no piece; rows with null or repeated ids are packed
    like any other; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "packing")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(file_place() if in_file_order else (F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in PLACE.split(", "))))
    # written once: a piece's place in its task's count must not change between its uses
    cut = scratch.save(pieces(own, tokenizer, end_id, capacity, remembered), "pieces", batch=ROWS)
    part = ["length", "file", "name", "first"]
    counts = cut.groupBy(part).agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("file", "name", "first")
    bases = scratch.save(counts.select(*part, "n", (F.sum("n").over(order) - F.col("n")).alias("base")), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    firsts = {length: [r[0] for r in found] for length, found in runs.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                first, each, at, begin = runs[length][bisect_right(firsts[length], rank) - 1]
                k = rank - first
                sequence.append(at + k // each)
                offset.append(begin + k % each * length)
            columns = {c: b.column(c) for c in b.schema.names if c != "rank"}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    # lengths times tasks: a table that grows with the corpus, so it isn't broadcast
    ranked = cut.join(bases.select(*part, "base").hint("merge"), part).withColumn("rank", F.col("base") + F.col("nth"))
    columns = [c.split()[0] for c in PIECE.split(", ")]
    if not in_file_order:
        return ranked.select(*columns, "rank").mapInArrow(placed, f"{PIECE}, sequence_id long, offset long")
    out = scratch.save(ranked.select(*columns, "file", "name", "row", "rank").mapInArrow(placed, f"{PIECE}, {PLACE}, sequence_id long, offset long"), "placed")
    sequences = out.groupBy("sequence_id").agg(F.min(F.struct("file", "name", "row", "piece")).alias("f"))
    sequences = sequences.select("sequence_id", F.col("f.file").alias("at_file"), F.col("f.name").alias("at_name"), F.col("f.row").alias("at_row"), F.col("f.piece").alias("at_piece"))
    number = numbered(scratch, sequences, ["at_file", "at_name", "at_row", "at_piece"], "sequences").select("sequence_id", "number")
    return out.join(number, "sequence_id").select(*columns, F.col("number").alias("sequence_id"), "offset")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
