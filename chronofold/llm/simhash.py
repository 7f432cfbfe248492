"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprints of 64 bits link when they differ in at most two bits. Each
fingerprint is cut into three segments (22, 21 and 21 bits, padded to the 23
bits of the perfect binary Golay code). Two errors over three segments leave at
least one segment without error (pigeonhole), and every segment has at most two.
For vectors x, y at distance <= 2 take z within distance 1 of both: the codeword
nearest to z is within 4 of x and of y. So the codewords within distance 4 of a
segment (one of them, or six) are keys that near segments must share. A key is
(segment i, its exact value, one codeword of the segment after it): each pair
within two bits shares one, and few other pairs do.

Keys with up to ``bucket`` fingerprints are verified in one task, which returns a
spanning forest of the verified links. Fingerprints in a larger key take the
exact way for any size: each is listed under every mask of two erased bits
(2016 of them); the fingerprints under one mask are at most four, all linked.

Documents that are merely similar differ in more bits, by chance in so many that
no bound tells them from others. ``similar`` therefore takes fingerprints for
finding and sets of shingles (as 64-bit hashes) for deciding. Pairs that share a
Golay key come first; what they have connected need not be compared again. Then
come keys that every pair meets under: two sets of a Jaccard similarity of at
least t that are put in one common order, rare shingles first, share a shingle
among the first ``n - ceil(t * n) + 1`` of each (their heads). How often shingles
occur is counted in a table of hashed counters, which decides the order only.
Under such a key, first a few partners a set are compared, at last all pairs of
sets that aren't connected yet. A pair of these leaves its task under one key
only, and only if its sizes and its sketches (shingles counted in
parts of the hash space, which bounds what two sets can share) allow t. Every pair
is verified on its whole sets.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, components, table, tidy, unused

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (shift, width)
COUNTERS = 1 << 18  # hashed counters of shingles
ROUNDS = (("golay", 4), ("head", 8), ("head", None))  # where pairs of sets meet, and with how many partners each is compared
CLOSE = 16  # differing bits of 64, at most, for pairs that meet under a Golay key
PARTS, LOW, NO_KEY = 128, 4, -(2**63)
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, the (23, 12) Golay code


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit word's low part, error patterns by syndrome).

    ``errors[s]`` holds up to six error patterns of weight <= 4 with syndrome s,
    padded by repeating the first: the vectors x ^ errors[s] are the codewords
    within distance 4 of x.
    """
    def syndrome(words: np.ndarray) -> np.ndarray:
        r = words.copy()
        for bit in range(22, 10, -1):
            r = np.where((r >> bit) & 1 == 1, r ^ (GENERATOR_REV << (bit - 11)), r)
        return r

    ones = syndrome(np.int64(1) << np.arange(23, dtype=np.int64))
    lists: list[list[int]] = [[] for _ in range(2048)]
    bits = range(23)
    import itertools

    for weight in range(5):
        for combo in itertools.combinations(bits, weight):
            s = e = 0
            for b in combo:
                s ^= int(ones[b])
                e |= 1 << b
            lists[s].append(e)
    errors = np.zeros((2048, 6), dtype=np.int64)
    for s, found in enumerate(lists):
        assert len(found) in (1, 6), "the code is perfect with covering radius 3"
        errors[s] = (found * 6)[:6]
    return ones, errors


GENERATOR_REV = int(f"{GENERATOR:012b}"[::-1], 2)  # the reciprocal polynomial generates an equivalent code


def codewords_near(x: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word: (n, 6), repeats where only one is."""
    ones, errors = golay()
    s = np.zeros(len(x), dtype=np.int64)
    for b in range(23):
        s ^= np.where((x >> b) & 1 == 1, ones[b], 0)
    return (x[:, None] ^ errors[s]) >> 11  # systematic: the high 12 bits are the data


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row index, key) of all keys of the fingerprints (uint64), without repeats in a row."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [codewords_near(p) for p in parts]
    rows, keys = [], []
    for i in range(3):
        n = near[(i + 1) % 3]
        key = (np.int64(i) << 40) | (parts[i][:, None] << 12) | n
        once = np.concatenate([np.ones((len(fp), 1), bool), n[:, 1:] != n[:, :1]], axis=1)
        r = np.broadcast_to(np.arange(len(fp))[:, None], n.shape)
        rows.append(r[once])
        keys.append(key[once])
    return np.concatenate(rows), np.concatenate(keys)


def _shingles(text: str | None, words: int) -> list[bytes]:
    """Space-joined shingles of A-Z lower-cased words, with repeats; the whole sequence where it is shorter."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [joined] if parts else []
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    return [joined[a:b] for a, b in zip(starts, ends)]


def _majority(digests: bytes, width: int) -> bytes:
    """Bits set in over half of the digests, of ``width`` bytes each."""
    h = np.frombuffer(digests, dtype=np.uint8).reshape(-1, width)
    ones = np.zeros(8 * width, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash by majority over the XXH64 (seed 42) of word shingles; 0 for no words."""
    digest = xxhash.xxh64_digest
    return int.from_bytes(_majority(b"".join([digest(s, 42) for s in _shingles(text, words)]), 8), "big")


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted XXH3 (64 bits, seed 42) of the distinct word shingles."""
    return np.array(sorted({xxhash.xxh3_64_intdigest(s, 42) for s in _shingles(text, words)}), dtype=np.uint64)


def set_print(hashes: np.ndarray) -> int:
    """One signed long for a set: equal sets have equal ones."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), 42)).astype(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes, as a signed long; 0 for the empty set."""
    return int.from_bytes(_majority(hashes.tobytes(), 8), "big", signed=True)


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes are in each of ``PARTS`` parts of the hash space, modulo 16, two counts in a byte."""
    counts = np.bincount((hashes % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) & 15
    return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, rep: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, by breadth-first search over blocks of popcounts."""
    todo = np.ones(len(fp), bool)
    edges = []
    for seed in range(len(fp)):
        if not todo[seed]:
            continue
        todo[seed] = False
        front = np.array([seed])
        while len(front):
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            nxt = []
            for f in front:
                hit = rest[np.bitwise_count(fp[rest] ^ fp[f]) <= bits]
                if len(hit):
                    edges += [(int(rep[f]), int(rep[h])) for h in hit]
                    todo[hit] = False
                    nxt.append(hit)
                    rest = rest[todo[rest]]
            front = np.concatenate(nxt) if nxt else np.array([], dtype=np.int64)
    return edges


def links(spark: SparkSession, reps: DataFrame, scratch: Scratch, bits: int = 2, bucket: int = 1024) -> DataFrame:
    """Edges (u, v) between the ids of ``reps(fp, rep)``, distinct fingerprints, that connect what links connect.

    No rows, or none that link, give no edges; nulls don't occur in ``reps``.
    """
    if bits > 2:
        raise ValueError("the Golay keys guarantee pairs of up to two differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            rows, keys = golay_keys(fp.view(np.uint64))
            for k in range(0, len(rows), 1 << 17):
                r = rows[k : k + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 17)]), pa.array(fp[r]), pa.array(rep[r])], names=["key", "fp", "rep"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for members in b.column(0).to_pylist():
                fp = np.array([m["fp"] for m in members], dtype=np.int64).view(np.uint64)
                rep = np.array([m["rep"] for m in members], dtype=np.int64)
                out.update(_forest(fp, rep, bits))
            u, v = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a in range(64) for b in range(a)]
        mask = np.array([(1 << a) | (1 << b) for a, b in pairs], dtype=np.uint64)
        where = np.arange(len(pairs), dtype=np.int32)
        for b in batches:
            fp, rep = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 64):
                f = fp[k : k + 64]
                rest = (f[:, None] & ~mask[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(where, len(f))), pa.array(rest), pa.array(np.repeat(rep[k : k + 64], len(mask)))], names=["mask", "rest", "rep"])

    keys = scratch.save(reps.select("fp", "rep").mapInArrow(keyed, "key long, fp long, rep long"), "keys")
    sizes = scratch.save(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    small = keys.join(sizes.where(F.col("n") <= bucket).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
    near = small.select("members").mapInArrow(verified, "u long, v long")
    hot = keys.join(sizes.where(F.col("n") > bucket).select("key"), "key").select("fp", "rep").distinct()
    wide = hot.mapInArrow(masked, "mask int, rest long, rep long").groupBy("mask", "rest").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    wide = wide.select(F.array_min("reps").alias("u"), F.explode("reps").alias("v")).where("u <> v")
    return near.union(wide).distinct()


def _classes(spark: SparkSession, fps: DataFrame, prints: list[str], reps: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``fps`` with ``component_id``: the smallest id that links reach; null where the id is."""
    # an id that is repeated with other texts stands for several fingerprints: these become one node, which is right for reachability
    first, last = F.min(F.struct(*prints)), F.max(F.struct(*prints))
    same = fps.where("doc_id is not null").groupBy("doc_id").agg(first.alias("a"), last.alias("b")).where("a <> b").select("doc_id")
    own = fps.join(same, "doc_id", "left_semi").join(reps, prints).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(spark, edges.union(own), scratch)
    by_print = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(*prints, F.coalesce("root", "rep").alias("component_id"))
    out = fps.join(by_print, prints, "left")
    return out.select("doc_id", *prints, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2, bucket: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    Defined results: a null text counts as empty; texts without words have
    fingerprint zero and link like any other; rows with a null id are returned
    with a null component_id and link nothing; repeated ids are returned as
    often as they come; an empty table gives an empty result; other columns of
    ``docs``, whatever their names, are not read.
    """
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs, id_col, text_col, words), "fps")
    reps = scratch.save(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    return _classes(spark, fps, ["fp"], reps, links(spark, reps, scratch, bits, bucket), scratch)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of batches of long columns that are sorted by the first one; its runs stay whole."""
    kept: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
        if kept and kept[0][0, 0] == now[-1, 0]:  # one run goes on
            kept.append(now)
            continue
        cut = int(np.searchsorted(now[:, 0], now[-1, 0]))  # the last key may go on
        if cut or kept:
            yield np.concatenate([*kept, now[:cut]])
        kept = [now[cut:]]
    if kept:
        yield np.concatenate(kept)


def _run_sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the row's run, its end, its length) of each row of a sorted array."""
    border = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(border)
    return np.repeat(border[:-1], size), np.repeat(border[1:], size), np.repeat(size, size)


def _neighbours(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i before j, of each row with its run's first one and with the one before it."""
    start, _, _ = _run_sizes(rows[:, 0])
    at = np.arange(len(rows))
    for i, j in ((start, at), (at[:-1], at[1:])):
        ok = (start[i] == start[j]) & (i != j)
        yield i[ok], j[ok]


def _sized(rows: np.ndarray, i: np.ndarray, j: np.ndarray, share: Fraction) -> np.ndarray:
    """Can the sets reach ``share`` by their sizes, and is their root another? i is not larger than j."""
    return (rows[i, 1] * share.denominator >= rows[j, 1] * share.numerator) & (rows[i, 4] != rows[j, 4])


def _placed(rows: np.ndarray, i: np.ndarray, j: np.ndarray, share: Fraction) -> np.ndarray:
    """... and by the places of the shared shingle: after the first one, no more can be shared than what follows."""
    n, place = rows[:, 1], rows[:, 3]
    rest = np.minimum(n[i] - place[i], n[j] - place[j])
    return _sized(rows, i, j, share) & (rest * (share.numerator + share.denominator) >= share.numerator * (n[i] + n[j]))


def _here(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Is this key the least one that the pair meets under? Also true where the lists of least keys can't tell.

    If two sets' lists of their least keys share a key, the least such key is the
    least that the sets share at all.
    """
    a, b = rows[i, 5 : 5 + LOW], rows[j, 5 : 5 + LOW]
    both = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a != NO_KEY)
    least = np.where(both, a, 2**63 - 1).min(axis=1)
    return ~both.any(axis=1) | (least == rows[i, 0])


def _sketched(rows: np.ndarray, i: np.ndarray, j: np.ndarray, share: Fraction) -> np.ndarray:
    """Do the sketches leave room for ``share``? Counts that differ by d have d shingles that aren't shared."""
    a, b = (np.ascontiguousarray(rows[k, 5 + LOW :]).view(np.uint8) for k in (i, j))
    apart = np.zeros(len(i), dtype=np.int64)
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        d = (x - y) & 15
        apart += np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
    n = rows[i, 1] + rows[j, 1]
    return (n - apart) * (share.numerator + share.denominator) >= 2 * share.numerator * n


def _all_pairs(rows: np.ndarray, share: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a run that may reach ``share`` and meet here; rows are sorted by key and size."""
    _, end, _ = _run_sizes(rows[:, 0])
    shift, at = 1, np.arange(len(rows))
    at = at[end - at > 1]
    while len(at):
        at = at[rows[at, 1] * share.denominator >= rows[at + shift, 1] * share.numerator]  # sizes only grow
        for k in range(0, len(at), 1 << 14):
            i = at[k : k + (1 << 14)]
            # places say nothing here: the least shared key needn't be the first one in the sets' order
            for test in (_sized, lambda r, i, j, _: _here(r, i, j), _sketched):
                i = i[test(rows, i, i + shift, share)] if len(i) else i
            if len(i):
                yield i, i + shift
        shift += 1
        at = at[end[at] - at > shift]


def similar(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, print, component_id): documents whose sets of shingles have a Jaccard similarity of at least ``similarity`` link.

    Defined results as for ``near_duplicates``; texts without words are equal.
    """
    scratch = Scratch(spark, "similar")
    share = Fraction(str(similarity))
    if not 0 < share <= 1:
        raise ValueError("the similarity is above 0 and at most 1")

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["doc_id", "print", "n", "fp", "sketch", "counts"]
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                counts += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                made = [part.column(0), [set_print(s) for s in sets], [len(s) for s in sets], [set_fingerprint(s) for s in sets], [sketch(s) for s in sets], [None] * len(sets)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(made, kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip((None, None, None, None, None, zlib.compress(counts.tobytes(), 1)), kinds)], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            for c in b.column(0):
                counts += np.frombuffer(zlib.decompress(c.as_py()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["counts"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = scratch.save(own.mapInArrow(tidy(printed), "doc_id long, print long, n long, fp long, sketch binary, counts binary"), "prints")
    fps = both.where("counts is null").select("doc_id", "print")
    known = both.where("counts is null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    known = scratch.save(known, "reps")
    reps = known.select("print", "rep")
    total = both.where("counts is not null").select("counts").repartition(1).mapInArrow(summed, "counts binary").first()
    often = np.frombuffer(zlib.decompress(total["counts"]), dtype=np.int64)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                out = [np.empty((0, 4), dtype=np.int64)]
                for t in b.column(1).slice(k, 1024).to_pylist():
                    s = shingle_set(t, words)
                    n, me = len(s), set_print(s)
                    if not n or me in seen:
                        continue
                    if len(seen) < 1 << 17:
                        seen.add(me)
                    head = n + 1 - -(-share.numerator * n // share.denominator)
                    order = np.lexsort((s, often[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:head]
                    out.append(np.stack([s[order].view(np.int64), np.full(head, n), np.full(head, me), np.arange(head)], axis=1))
                rows = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names=["key", "n", "print", "place"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]  # equal sets of other tasks
            rows = rows[_run_sizes(rows[:, 0])[2] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names=["key", "n", "print", "place"])

    kind = "key long, n long, print long, place long"
    keys = own.where("doc_id is not null").mapInArrow(tidy(heads), kind).repartition("key").sortWithinPartitions("key", "n", "print", "place")
    keys = scratch.save(keys.mapInArrow(shared, kind), "keys")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                sets = [shingle_set(t, words) for t in b.column(1).slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["print", "hashes"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common * share.denominator >= share.numerator * (len(x) + len(y) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                n, me, fp = (b.column(c).slice(k, 4096).to_numpy(zero_copy_only=False) for c in range(3))
                r, keys = golay_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys, n[r], me[r], fp[r], me[r])], names=["key", "n", "print", "fp", "root"])

    def pairs_of(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[k, 2]) for k in (i, j)], names=["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            for i, j in _neighbours(rows):
                ok = _sized(rows, i, j, share) & (np.bitwise_count((rows[i, 3] ^ rows[j, 3]).view(np.uint64)) <= CLOSE)
                yield pairs_of(rows, i[ok], j[ok])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            for i, j in _neighbours(rows):
                ok = _placed(rows, i, j, share)
                yield pairs_of(rows, i[ok], j[ok])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(flat(batches)):
            for i, j in _all_pairs(rows, share):
                yield pairs_of(rows, i, j)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sketch as longs."""
        for b in batches:
            longs = np.frombuffer(b"".join(b.column(b.num_columns - 1).to_pylist()), dtype=np.int64).reshape(-1, PARTS // 16)
            columns = [*b.columns[:-1], *(pa.array(c) for c in longs.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=[str(c) for c in range(len(columns))])

    def sorted_by_key(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "n", "print")

    roots = spark.createDataFrame([], "id long, root long")  # what is connected so far; ids that are their own root aren't in it

    def rooted_by(found: DataFrame, end: str) -> DataFrame:
        return found.join(roots.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")

    for k, (where, most) in enumerate(ROUNDS):
        if where == "golay":
            met_rows = sorted_by_key(known.where("n > 0").select("n", "print", "fp").mapInArrow(keyed, "key long, n long, print long, fp long, root long"))
            pairs = met_rows.mapInArrow(near, "a long, b long")
        else:
            rooted = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("root", "rep").alias("root"))
            rows = keys.join(rooted, "print").select("key", "n", "print", "place", "root")
            if most is None:  # only keys that still part something matter, and then a set's sketch and its least keys
                rows = scratch.save(rows, "rooted")
                live = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
                rows = scratch.save(rows.join(live, "key", "left_semi"), "live")
                scratch.drop("rooted", "keys")
                low = rows.groupBy("print").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW).alias("low"))  # a set's head is bounded by its text
                least = [F.coalesce(F.get("low", F.lit(c)), F.lit(NO_KEY)).alias(f"low{c}") for c in range(LOW)]
                extra = low.join(known.select("print", "sketch"), "print").select("print", *least, "sketch")
                rows = rows.join(extra, "print").select("key", "n", "print", "place", "root", *(f"low{c}" for c in range(LOW)), "sketch")
            pairs = sorted_by_key(rows).mapInArrow(every if most is None else met, "a long, b long")
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
        if most is not None:  # the partners of the most shared keys
            pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))).where(F.col("nth") <= most)
        pairs = scratch.save(pairs.select("a", "b"), f"pairs-{k}")
        if most is None:
            scratch.drop("live")
        if pairs.isEmpty():
            continue
        need = pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct().join(reps, "print")
        sets = own.join(need.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(tidy(sets_of), "print long, hashes binary")
        sets = scratch.save(sets.join(need.select("print"), "print", "left_semi").dropDuplicates(["print"]), f"sets-{k}")
        full = pairs.join(sets.select(F.col("print").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("print").alias("b"), F.col("hashes").alias("y")), "b")
        found = full.select("a", "b", "x", "y").mapInArrow(tidy(verified), "a long, b long")
        found = found.join(reps.select(F.col("print").alias("a"), F.col("rep").alias("u")), "a").join(reps.select(F.col("print").alias("b"), F.col("rep").alias("v")), "b")
        found = scratch.save(found.select("u", "v"), f"edges-{k}")
        # links between what was connected before: a small graph of roots, whose own roots replace them
        more = components(spark, rooted_by(rooted_by(found, "u"), "v").select("u", "v"), Scratch(spark, f"similar-{k}"))
        moved = roots.join(more.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
        roots = scratch.save(moved.union(more), f"roots-{k}")
        scratch.drop(f"pairs-{k}", f"sets-{k}")
    return _classes(spark, fps, ["print"], reps, roots.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``similar`` ones: that with the smallest id.

    Rows with a null id all stay; rows that repeat the kept id stay together.
    """
    name = unused(docs.columns, "gone")
    gone = similar(spark, docs, id_col, text_col, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
