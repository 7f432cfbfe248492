"""Token-id output as length-delimited binary records, with a separate offset index.

File format (version 1), one file per shard, shards in ascending document order:

    frame   = length  u64 LE | masked crc32 of those 8 bytes u32 LE
            | payload        | masked crc32 of the payload   u32 LE | 0x0A
    payload = flag u8 (1: the document has an id) | width u8 | doc_id i64 LE
            | ids, unsigned LE, of 2 bytes each where the vocabulary allows it, else 4

A checksum is masked (rotated right by 15 bits, plus a constant) so that the
checksum of a file that holds checksums stays meaningful. The index is a Parquet
table (shard, doc_id, offset, length, tokens_before, n_tokens) in which ``offset``
and ``length`` place a frame in its file: a reader can seek to any document.

Files are written by Spark's text writer, which copies bytes as they are: so any
store that Spark writes to will do, and a task that is lost or tried twice leaves
one complete file or none.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, bounded, table, tidy
from chronofold.llm.tokens import GROUP, encoder

HEAD, PAYLOAD_HEAD, CRC = struct.Struct("<QI"), struct.Struct("<BBq"), struct.Struct("<I")
END = b"\n"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """One record of 4-byte ids, kept in ``width`` bytes each, without the final line feed, which the writer adds."""
    if width == 2:
        ids = np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
    payload = PAYLOAD_HEAD.pack(doc_id is not None, width, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return size + CRC.pack(masked_crc(size)) + payload + CRC.pack(masked_crc(payload))


def read_frame(data: bytes | memoryview, at: int) -> tuple[int | None, bytes, int]:
    """(doc_id, ids of 4 bytes each, place of the next frame); raises ValueError where a checksum or a length is wrong."""
    view = memoryview(data)
    if at + HEAD.size > len(view):
        raise ValueError(f"record at {at}: the file ends in its head")
    size, crc = HEAD.unpack_from(view, at)
    if masked_crc(view[at : at + 8]) != crc:
        raise ValueError(f"record at {at}: its length is damaged")
    begin = at + HEAD.size
    end = begin + size
    if end + CRC.size + len(END) > len(view) or size < PAYLOAD_HEAD.size:
        raise ValueError(f"record at {at}: the file ends within it")
    payload = view[begin:end]
    if masked_crc(payload) != CRC.unpack_from(view, end)[0] or view[end + 4 : end + 5] != END:
        raise ValueError(f"record at {at}: its content is damaged")
    known, width, doc_id = PAYLOAD_HEAD.unpack_from(payload)
    ids = np.frombuffer(payload[PAYLOAD_HEAD.size :], dtype=f"<u{width}").astype("<u4").tobytes()
    return doc_id if known else None, ids, end + CRC.size + len(END)


def write_records(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int | None, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write them below ``path``: ``records`` (files) and ``index``.

    Defined results: null text is an empty one; null ids come first; repeated
    ids are ordered by text; an empty table gives no records. The number of
    shards follows the bytes of text, so shards stay near ``shard_bytes``.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for b in batches:
            for part in bounded(b, 1, GROUP):
                out = [frame(d, ids + end, width) for d, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1).to_pylist()))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    ordered = own.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(frames, "tokens"), "frame binary").select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(f"{path}/records")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = memoryview(content.as_buffer())
                at = before = 0
                rows = []
                while at < len(data):
                    doc_id, ids, nxt = read_frame(data, at)
                    rows.append((shard, doc_id, at, nxt - at, before, len(ids) // 4))
                    before += len(ids) // 4
                    at = nxt
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 6)], names=["shard", "doc_id", "offset", "length", "tokens_before", "n_tokens"])

    index = _files(spark, path).mapInArrow(tidy(places, "tokens"), "shard long, doc_id long, offset long, length long, tokens_before long, n_tokens long")
    index.write.mode("overwrite").parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids) of all records; every checksum is verified.

    A whole read goes through the files in order, where they lie; only the number
    of tokens in each shard comes from the index. Defined results: records without
    an id have a null one, repeated ids come as often as written, no records give an
    empty table; a damaged record is an error.
    """
    totals = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per shard, so this window over all of them stays small
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = memoryview(content.as_buffer())
                at = before = 0
                while at < len(data):
                    rows = []
                    while at < len(data) and len(rows) < 512:
                        doc_id, ids, at = read_frame(data, at)
                        rows.append((doc_id, shard, before, len(ids) // 4, ids))
                        before += len(ids) // 4
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]), pa.array([r[4] for r in rows], pa.binary())], names=["doc_id", "shard", "before", "n_tokens", "ids"])

    read = _files(spark, path).mapInArrow(tidy(fetch, "tokens"), "doc_id long, shard long, before long, n_tokens long, ids binary")
    # the query's digests are taken before the join, so that the ids themselves are not moved for them
    return read.withColumn("ids_crc32", F.crc32("ids")).join(bases, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents in ``wanted(doc_id)``, by their places in the index.

    For shuffled reads of a part of the corpus: only the shards that hold such a
    document are opened, and only its frame is decoded. Defined results: null and
    unknown ids give no row, an id that is asked for twice is read once, a repeated
    id gives all its records.
    """
    index = spark.read.parquet(f"{path}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    lists = index.groupBy("shard").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # as long as a shard at most

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, offsets in zip(b.column(0), b.column(1).to_pylist()):
                data = memoryview(content.as_buffer())
                rows = [read_frame(data, at)[:2] for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) // 4 for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _files(spark, path).join(lists, "shard").select("content", "offsets").mapInArrow(tidy(fetch, "tokens"), "doc_id long, n_tokens long, ids binary")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "records")
    path = scratch.path("tokens")
    write_records(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
