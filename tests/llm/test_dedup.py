"""SimHash and line dedup against brute force."""

import time

import numpy as np
from pyspark.sql import functions as F

from chronofold.llm import lines, simhash
from chronofold.llm.common import CLEANUP, Scratch, components

SF = "/root/testdata/sf0.001"


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_keys_meet_at_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for bits in (0, 1, 2):
        y = x.copy()
        for row in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[row] ^= np.uint64(1 << int(b))
        keys = [[set() for _ in x] for _ in (x, y)]
        for mine, z in zip(keys, (x, y)):
            for r, k in zip(*simhash.golay_keys(z)):
                mine[r].add(k)
        assert all(a & b for a, b in zip(*keys))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(39, 3), (5, 5)]
    want = classes(edges, {i for e in edges for i in e})
    for hub in (5, 10**6):
        got = components(spark, spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), hub).collect()
        assert {r["id"]: r["root"] for r in got} == {i: r for i, r in want.items() if i != r}


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    counts = spark.range(2000).groupBy((F.col("id") % 100).alias("g")).count()
    before, held, scratch = shuffle_files(spark), spark.conf.get(CLEANUP), Scratch(spark, "t")
    for name in ("once", "again"):
        saved = scratch.save(counts, name)
        until = time.time() + 10
        while (left := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left and spark.conf.get(CLEANUP) == held
    assert saved.count() == counts.count() == 100


def test_links_with_small_and_large_keys(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    fps += [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (120, 2))]
    fps = sorted(set(np.array(fps, dtype=np.uint64).view(np.int64).tolist()))
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    want = classes([(i, j) for i in range(len(u)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 2], range(len(u)))
    for bucket in (4, 1024):
        e = simhash.links(spark, reps, Scratch(spark, "t"), bucket=bucket).collect()
        assert all(int(u[r["u"]] ^ u[r["v"]]).bit_count() <= 2 for r in e)
        assert classes([(r["u"], r["v"]) for r in e], range(len(u))) == want


def test_fingerprint_rules():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tB ")
    assert simhash.fingerprint("É b") != simhash.fingerprint("é b")  # only A-Z is lowered
    assert simhash.fingerprint("a b c d") == simhash.fingerprint("a  b\nc d")


def plain_fingerprint(text):
    """The contract's fingerprint by Python integers, one bit at a time."""
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_the_contract(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", "one", "Two words", "É\u00a0x y\x0bz\x0c w\x1f"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(1000, None), (1001, ""), (1002, docs[0]["text"]), (1002, docs[0]["text"]), (None, "a b c"), (1003, "a b c"), (1004, "word " * 30000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, rep int")
    got = simhash.near_duplicates(spark, df).collect()
    assert len(got) == len(rows)
    fp = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fp)
    want = classes([(a, b) for a in ids for b in ids if b < a and (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    assert {r["doc_id"]: r["component_id"] for r in got} == {**want, None: None}
    assert simhash.near_duplicates(spark, df.limit(0)).count() == 0


def test_one_id_with_two_texts_joins_both(spark):
    df = spark.createDataFrame([(1, "a b c d"), (5, "x y z w"), (5, "a b c d"), (9, "x y z w")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(spark, df).collect()} == {1}


def test_similar_documents_meet_and_others_stay(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, near = [], []
    for i in range(60):
        words = list(rng.choice(vocabulary, 400))
        rows.append((i, " ".join(words)))
        for at in rng.choice(390, 6, replace=False):
            words[at] = "other"
        near.append((i, i + 100))
        rows.append((i + 100, " ".join(words)))
    df = spark.createDataFrame([*rows, (None, "a"), (300, None), (301, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, df).collect()}
    assert np.mean([got[b] == a for a, b in near]) >= 0.9
    assert all(got[i] in (i, i - 100) for i, _ in rows) and got[301] == 300
    kept = simhash.deduplicate(spark, df)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id < 100").count() == 60


def test_similar_matches_brute_force_jaccard(spark):
    rng = np.random.default_rng(8)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    # one passage many times outweighs all else in a SimHash, but is a small part of the set
    rows += [(2000 + i, "the same few words again and again " * 80 + " ".join(rng.choice([f"w{k}" for k in range(4000)], 300))) for i in range(3)]
    base = [f"v{k}" for k in rng.integers(0, 4000, 300)]
    for i in range(60):  # similarities around 0.8
        words = list(base[i:])
        for at in rng.choice(len(words), rng.integers(1, 10), replace=False):
            words[at] = f"u{i}"
        rows.append((3000 + i, " ".join(words)))
    rows += [(4000, None), (4001, ""), (4002, "two words"), (4003, "Two  words")]
    sets = {i: set(simhash._shingles(t, 5)) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if b < a and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))]
    assert sum(sets[a] != sets[b] for a, b in pairs) > 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(spark, df).collect()} == classes(pairs, ids)
    assert simhash.similar(spark, df.limit(0)).count() == 0


def brute_repeats(rows, min_words):
    first, marked = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for n, (a, b, w, h) in enumerate(lines.units(t)):
            if first.setdefault(h, (d, a)) != (d, a):
                marked.setdefault(d, {})[n] = (a, b, w)
    out = []
    for d, at in marked.items():
        run = []
        for n in sorted(at) + [None]:
            if run and (n is None or n != run[-1] + 1):
                if sum(at[k][2] for k in run) >= min_words:
                    out.append((d, at[run[0]][0], at[run[-1]][1], sum(at[k][2] for k in run)))
                run = []
            run += [n] if n is not None else []
    return sorted(out)


def test_repeated_passages_match_brute_force(spark):
    passage = " ".join(f"sentence number {k} of the shared text has quite some words." for k in range(6))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(500, f"Begin here {passage} and go on."), (501, f"Other words\n{passage}\nend"), (502, None), (503, ""), (None, passage), (504, "x\n" * 2000), (505, "a short line.\nown words"), (506, "a short line.\nmore")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, digest string, start int")
    got = lines.repeated(spark, df)
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in got.collect()) == brute_repeats(rows, 20)
    assert {501} <= {r["doc_id"] for r in got.where("first_doc_id = 500").collect()}
    assert got.where("doc_id in (505, 506)").count() == 0
    clean = {r["doc_id"]: r["text"] for r in lines.remove(df, got).collect()}
    # the first sentence of the kept occurrence runs on from the words before it, so it is another unit
    assert clean[501] == "Other words\nsentence number 0 of the shared text has quite some words. end"
    assert clean[500] == rows[-8][1] and clean[502] is None
    assert lines.repeated(spark, df.limit(0)).count() == 0


def test_passages_that_run_into_their_neighbours_are_found(spark):
    """Verbatim repeats of 50 words, without regard to sentences: what share of their words goes from the later copy."""
    rng = np.random.default_rng(12)
    vocabulary = [f"{a}{b}" for a in ("st", "en", "or", "ti", "wa", "re") for b in ("ond", "ing", "el", "ur", "a", "ix", "om", "y")]

    def words(n):
        return [w + (". " if rng.random() < 0.08 else " ") for w in rng.choice(vocabulary, n)]

    rows, places = [], {}
    for k in range(80):
        passage = "".join(words(50))
        for d in (2 * k, 2 * k + 1):
            before = "".join(words(rng.integers(3, 60)))
            rows.append((d, before + passage + "".join(words(rng.integers(3, 60)))))
        places[2 * k + 1] = (len(before), len(before) + len(passage))
    found = {}
    for r in lines.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    gone = [sum(max(0, min(b, e) - max(a, s)) for s, e in found.get(d, [])) / (b - a) for d, (a, b) in places.items()]
    assert np.mean([g >= 0.5 for g in gone]) >= 0.95 and np.mean(gone) >= 0.7
    outside = sum(e - s for x in found.values() for s, e in x) - sum(g * (b - a) for g, (a, b) in zip(gone, places.values()))
    assert outside < 0.02 * sum(len(t) for _, t in rows)


def test_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_words"]) for r in lines.op9_line_hashing(spark, SF).collect()) == brute_repeats(rows, 20)


def test_lines_match_plain_grouping(spark):
    """Whole lines against a dictionary of normalised lines, made without the module's units."""
    edge = " \t\"'“”‘’«»()[]{}-–—*#%&$|.,;:!?…"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    spans, seen, later = {}, set(), 0
    for r in lines.repeated(spark, spark.read.parquet(f"{SF}/documents.parquet"), whole_lines=True).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for d, text in rows:
        at = 0
        for line in text.split("\n"):
            plain = " ".join(line.lower().split()).strip(edge)
            if plain and plain in seen:
                later += 1
                a = at + len(line) - len(line.lstrip())
                assert any(s <= a and at + len(line.rstrip()) <= e for s, e in spans[d])
            seen.add(plain)
            at += len(line) + 1
    assert later > 0


def test_units_cover_places():
    text = "One. Two!  three 3.5 four\n\n  Five… end"
    assert [text[a:b].strip() for a, b, _, _ in lines.units(text)] == ["One.", "Two!", "three 3.5 four", "Five…", "end"]
    assert lines.units(None) == [] and lines.units("...") == []


def test_repeated_whole_lines_of_any_length(spark):
    rows = [(1, "Short line.\nown words here\n短い行です。"), (2, "other\n  short LINE\nmore"), (3, "Short line. And more on it."), (4, "短い行です。\nx"), (5, "Two parts. One line.\nyes"), (6, "no\nTwo parts.  One line.\nTwo parts. Another line.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.repeated(spark, df, whole_lines=True)
    text = dict(rows)
    assert sorted((r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]], r["first_doc_id"]) for r in got.collect()) == [(2, "  short LINE\n", 1), (4, "短い行です。\n", 1), (6, "Two parts.  One line.\n", 5)]
    assert lines.repeated(spark, df).count() == 0


def test_scripts_without_spaces_are_cut_and_counted():
    text = "今日は天気がいいです。明日も晴れるでしょう！" * 2
    assert [text[a:b] for a, b, _, _ in lines.units(text)] == ["今日は天気がいいです。", "明日も晴れるでしょう！"] * 2
    assert [w for _, _, w, _ in lines.units(text)] == [5, 5, 5, 5]


def test_every_repeated_line_goes_on_request(spark):
    spans, seen = {}, set()
    for r in lines.repeated(spark, spark.read.parquet(f"{SF}/documents.parquet"), whole_lines=True).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    later = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        cuts = lines.units(r["text"])
        places = lines.lines_of(r["text"], cuts)
        first = {}
        for (a, b, _, _), (begin, digest) in zip(cuts, places):
            if digest in seen or first.setdefault(digest, begin) != begin:
                later += 1
                assert any(s <= a and b <= e for s, e in spans[r["doc_id"]])
        seen.update(first)
    assert later > 0


def test_signs_at_a_line_end_go_with_its_words():
    assert [(a, b) for a, b, _, _ in lines.units("One. two. |\nx")] == [(0, 5), (5, 12), (12, 13)]
