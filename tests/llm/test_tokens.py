"""Token records and packing: round trips, damage, brute force."""

import functools
import weakref
import zlib
from bisect import bisect_left, insort
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronofold.llm import common, packing, records
from chronofold.llm.common import Scratch
from chronofold.llm.tokens import encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ROWS = [(3, "Hello there, it's 2 o'clock.\n\nNew  line"), (1, None), (2, ""), (7, "Ünïcode ñandú 字 <|endoftext|>"), (7, "again"), (None, "no id"), (5, "long text " * 20000)]


@functools.cache
def plain(path):
    t = Tokenizer.from_file(path)  # untouched, as the contract has it
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sTre 12\n\t\r.,!<|>endoftext"), st.characters(codec="utf-8")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_cached_ids_are_the_librarys(path, text):
    want = plain(path)(text)
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == want
    assert np.frombuffer(encoder(path).encode_all([None, text + " x\ny", text])[2], "<u4").tolist() == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_special_strings_and_long_texts(path, monkeypatch):
    def encode_all(t):
        return encoder(path).encode_all([t, "a b", t])[2]

    texts = ["one <|endoftext|> two", "a<|EndOfText|>b", "<|startoftext|><|endoftext|>", "x < | endoftext |> y", "it's  5\n\n 'twas — “odd” 字字 d'été\u00a0fin"]
    for t in [*texts, " ".join(texts) * 50, "字" * 5000 + " a", "long" * 3000 + " <|endoftext|>" + "  " * 999]:
        assert np.frombuffer(encoder(path).encode(t), "<u4").tolist() == np.frombuffer(encode_all(t), "<u4").tolist() == plain(path)(t)
    from chronofold.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 40)
    for t in [*texts, " ".join(texts) * 9, "no-border" * 30, "a  b " * 60, "é à\nü " * 40]:
        assert np.frombuffer(encoder(path).encode(t), "<u4").tolist() == plain(path)(t)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_whole_documents(path):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:400]
    for t, ids in zip(texts, encoder(path).encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(path)(t)


def test_cache_is_bounded(monkeypatch):
    from chronofold.llm import tokens

    cache = tokens._Cache(lambda p: b"1234", entries=10)
    for k in range(100):
        cache[f"w{k}"], cache["y" * 500]
        assert len(cache) + len(cache.older) <= 10 and "y" * 500 not in cache


def test_frames():
    ids = np.arange(5, dtype="<u4").tobytes()
    for width in (2, 4):
        data = records.frame(9, ids, width) + b"\n" + records.frame(None, b"", width) + b"\n"
        doc_id, got, nxt = records.read_frame(data, 0)
        assert (doc_id, got) == (9, ids) and records.read_frame(data, nxt) == (None, b"", len(data))
        for at in range(nxt):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                records.read_frame(bytes(broken), 0)
        with pytest.raises(ValueError):
            records.read_frame(data[: nxt - 3], 0)


def test_records_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS], "doc_id long, text string, shard int, ids int")
    path = Scratch(spark, "t").path("tokens")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")  # must not break shards up
    records.write_records(spark, df, path, WORD, 1, shard_bytes=1000)
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = sorted(records.read_records(spark, path).collect(), key=lambda r: r["start"])
    want = [(i, [*plain(WORD)(t), 1]) for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    start = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += len(ids)
    some = records.read_at(spark, path, spark.createDataFrame([(5,), (3,), (99,)], "doc_id long")).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in some} == {i: ids for i, ids in want if i in (3, 5)}
    empty = Scratch(spark, "t").path("none")
    records.write_records(spark, df.limit(0), empty, WORD, 1)
    assert records.read_records(spark, empty).count() == 0


def test_records_tasks_bound_and_give_back_memory(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path, given, plain_map = Scratch(spark, "t").path("tokens"), [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *rest: given.append(run) or plain_map(self, run, *rest))
    records.write_records(spark, df, path, WORD, 1)
    records.read_records(spark, path)
    records.read_at(spark, path, df)
    released = []
    monkeypatch.setattr(common, "release", lambda: released.append(1))
    frames, places, fetch, fetch_at = given
    texts = [f"text {k} " * 2500 for k in range(400)]  # some 9 MB in one batch
    out = list(frames(iter([pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])])))
    assert len(released) == 1 and max(b.num_rows for b in out) * min(map(len, texts)) <= 4 << 20
    data = b"".join(f + b"\n" for b in out for f in b.column(0).to_pylist())
    files = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([data], pa.binary())], names=["shard", "content"])
    index = [r for b in places(iter([files])) for r in b.to_pylist()]
    got = [r for b in fetch(iter([files])) for r in b.to_pylist()]
    some = pa.RecordBatch.from_arrays([files.column(1), pa.array([[index[k]["offset"] for k in (0, 399)]])], names=["content", "offsets"])
    at = [r for b in fetch_at(iter([some])) for r in b.to_pylist()]
    assert len(released) == 4
    want = [ids + (1).to_bytes(4, "little") for ids in encoder(WORD).encode_all(texts)]
    assert [r["ids"] for r in got] == want and [r["doc_id"] for r in index] == list(range(400))
    assert [(r["doc_id"], r["ids"]) for r in at] == [(0, want[0]), (399, want[399])]


def one_by_one(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bins += room == capacity
        if room - n:
            insort(rooms, room - n)
    return bins, rooms


@given(st.lists(st.integers(1, 32), max_size=200), st.sampled_from([32, 33, 50]))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for n, runs in packing.plan(histogram, capacity).items():
        for (first, each, at, begin), nxt in zip(runs, [r[0] for r in runs[1:]] + [histogram[n]]):
            for k in range(nxt - first):
                bins.setdefault(at + k // each, []).append((begin + k % each * n, n))
    rooms = []
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
        rooms += [capacity - at] if capacity > at else []
    assert (len(bins), sorted(rooms)) == one_by_one(lengths, capacity)


def test_pack(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS * 3], "doc_id long, text string, length int, part int")
    got = packing.pack(spark, df, BYTE, capacity=512).collect()
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in held.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 512
    want = []
    for i, t in ROWS * 3:
        ids = [*plain(BYTE)(t), 0]
        cuts = [0, *range(len(ids) % 512 or 512, len(ids) + 1, 512)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert len(held) == one_by_one([w[3] for w in want], 512)[0]
    assert packing.pack(spark, df.limit(0), BYTE).count() == 0


def test_workers_forget_what_other_operators_remembered():
    from chronofold.llm import quality, tokens

    def task(keeps):
        return list(common.tidy(lambda batches: batches, keeps)(iter([1])))

    common.forget(None)
    encoder(BYTE).encode("some words")
    cache = weakref.ref(encoder(BYTE).cache)
    quality.features(pa.array(["some words"]))
    assert task("tokens") == [1] and len(cache()) == 2 and not quality.WORDS
    quality.features(pa.array(["some words"]))
    assert task("words") == [1] and cache() is None and len(quality.WORDS) == 2 and not tokens.encoder.cache_info().currsize
    encoder(BYTE)
    assert task(None) == [1] and not quality.WORDS and not tokens.encoder.cache_info().currsize


def test_packing_tasks_bound_memory(spark, monkeypatch):
    df = spark.range(600).selectExpr("id doc_id", "repeat(concat('text ', id, ' '), 2000) text", "cast(null as long) file", "cast(null as string) name", "cast(null as long) row")
    given, sizes, before = [], [], spark.conf.get(common.BATCH)

    class Sized:
        def encode_all(self, texts):
            sizes.append(sum(map(len, texts)))
            return [b"1234"] * len(texts)

    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, run, *rest: given.append(run))
        m.setattr(packing, "encoder", lambda path, entries: Sized() if (path, entries) == (BYTE, 1000) else None)
        m.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
        packing.pieces(df, BYTE, 0, 2048, 1000)
        assert sum(b.num_rows for b in given[0](iter(df.toArrow().combine_chunks().to_batches()))) == 600
    assert max(sizes) <= 4 << 20 and sum(sizes) > 8 << 20
    rows = spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r["n"] for r in Scratch(spark, "t").save(rows, "few", batch=packing.ROWS).collect()) == packing.ROWS
    assert spark.conf.get(common.BATCH) == before and max(r["n"] for r in rows.collect()) == 5000
