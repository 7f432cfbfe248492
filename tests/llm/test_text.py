"""Pages, personal data, quality, mixing and the pipeline."""

import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from chronofold.llm import htmltext, mixing, pii, quality

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no";</script></head><body>
<header><h1>The site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-notice"><p>We use cookies, you know. Accept them.</p></div>
<div class=wrap><div class=col><h2>My&nbsp;title</h2><p>First long paragraph, with <b>some</b> text; and more,
to count.<p>Tiny &amp; short.<ul><li>One point is here.<li>Two</ul><p>Another long paragraph, with <a href="x">a link</a> in it.</div>
<div class="user-comments"><p>Great article, thank you very much. I liked it, a lot!</p></div><aside><p>Aside, text.</p></aside></div>
<form><p>Write, to us.</p></form><!-- <p>hidden, comment.</p> --><footer>&copy; us, all.</footer>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "My title\nFirst long paragraph, with some text; and more, to count.\nTiny & short.\nOne point is here.\nTwo\nAnother long paragraph, with a link in it."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p>") == ""
    assert htmltext.main_text("just text, no tags.") == "just text, no tags."
    for odd in ('<p a="', "<", "</", "<!--", "<script>x", "<p>x</div></p>", "<a" * 3000, "<b>" * 3000 + "x", "</div>" * 3000, "<li><p>" * 3000):
        htmltext.main_text(odd)


ARTICLE = "<h1>Title here</h1><p>First long paragraph, with some text; and more, to count it.</p><ul><li>One</li><li>Two</li></ul><p>Second paragraph has quite some words, too. It ends here.</p><blockquote><p>Quoted words, for once.</p></blockquote><table><tr><td>a<td>b</table><ul><li><a href=z>A source</a></li></ul>"
AROUND = '<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>%s<div class="comments"><p>Great article, thank you very much. I liked it, a lot!</p></div><footer>(c) us, all rights.</footer></body></html>'


@pytest.mark.parametrize("wrapper", ["<article>%s</article>", "<div>%s</div>", '<div class="layout with-sidebar">%s</div>', '<div class="post ad-free">%s</div>', '<section id="share-prices">%s</section>', '<main><div class="widget-area content">%s</div></main>', '<div class="social-science">%s</div>'])
def test_marks_around_an_article_take_nothing_away(wrapper):
    want = "Title here\nFirst long paragraph, with some text; and more, to count it.\nOne\nTwo\nSecond paragraph has quite some words, too. It ends here.\nQuoted words, for once.\na\nb\nA source"
    assert htmltext.main_text(AROUND % (wrapper % ARTICLE)) == want


def test_marked_parts_inside_an_article_go():
    inside = ARTICLE.replace("<ul><li>One", '<div class="share-bar"><p>Share this.</p></div><aside>See also.</aside><div class="ad">Buy it, now.</div><ul><li>One')
    assert htmltext.main_text(AROUND % f"<article>{inside}</article>") == htmltext.main_text(AROUND % f"<article>{ARTICLE}</article>")


def test_ratios_decide_where_nothing_is_marked():
    bare = "<html><body><div><ul>" + "<li>Alpha beta</li>" * 60 + f"</ul></div><div>{ARTICLE}</div><div>Some small print</div></body></html>"
    want = htmltext.main_text(AROUND % f"<div>{ARTICLE}</div>")
    assert htmltext.main_text(bare) == want
    assert htmltext.main_text(bare, ratios=False) != want


def test_depth_is_linear():
    import time

    took = []
    for n in (1000, 8000):
        began = time.process_time()
        assert htmltext.main_text("<div><p>text, here.</p>" * n).count("\n") >= 0.75 * n
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 0.1


def article_of(page):
    """The text between the article's tags, without a parser: right for the test tables only."""
    import html

    inner = re.sub("<br>", " ", re.sub("</?b>", "", re.search("<article>(.*)</article>", page, re.S)[1]))
    blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split("</?p>|</?h1>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_query(spark):
    got = {r["page_id"]: r for r in htmltext.op5_tag_paths(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[r["page_id"]]["text"] == article_of(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", PAGE, 2)], "page_id long, url string, html string, text int")
    assert [len(r["text"]) > 0 for r in htmltext.extract(df).collect()] == [False, False, True]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_pages_whose_tags_and_classes_say_nothing(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h).replace('class="ad"', 'class="q7"') for h in pages]
    assert np.mean([htmltext.main_text(b) == article_of(h) for h, b in zip(pages, bare)]) >= 0.9
    assert all(htmltext.main_text(re.sub(r"<(/?)article\b", r"<\1div", h)) == article_of(h) for h in pages)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_plain_patterns(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("a1@.+-() 25_b%04"), rng.integers(0, 40))) for _ in range(4000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["4" * 50000 + "@" + "a" * 50000, "é a@b.co_c@d.de 4539 1488 0343 6467"]
    for t in texts[:-2] + texts[-1:]:
        assert pii.base_spans(t) == plain_spans(t)
    pii.base_spans(texts[-2])


def test_random_field_on_held_out_rows():
    held = pii.labelled_table(200, seed=77)
    found = [set(x) for _, x in pii.find([t for t, _ in held], pii.trained())]
    right = sum(len(set(s) & f) for (_, s), f in zip(held, found))
    assert right / sum(len(s) for _, s in held) >= 0.9 and right / sum(map(len, found)) >= 0.95


#: Written by hand, not made by the table's rules: text and what is personal in it.
BY_HAND = [
    ("Reach Anna under anna.schmidt@firma-gmbh.de before Friday.", [("email", "anna.schmidt@firma-gmbh.de")]),
    ("My address is jane dot doe at mail dot example dot com, thanks!", None),
    ("write to info at example dot org please", [("email", "info at example dot org")]),
    ("The server answers on 192.168.17.4 most days.", [("ip", "192.168.17.4")]),
    ("Call me: +49 170 1234 567 after six.", [("phone", "+49 170 1234 567")]),
    ("Call (212) 555-0147 or come by.", [("phone", "(212) 555-0147")]),
    ("Her number, 415-555-0133, is new.", [("phone", "415-555-0133")]),
    ("Paid with 4111 1111 1111 1111 yesterday.", [("card", "4111 1111 1111 1111")]),
    ("card 4929-1234-5678-9012 was refused", [("card", "4929-1234-5678-9012")]),
    ('token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', [("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]),
    ("api_key: 5ebe2294ecd0e0f08eab7690d2a6ee69", [("secret", "5ebe2294ecd0e0f08eab7690d2a6ee69")]),
    ("In 1999 the town had 23,417 people and 2 mills.", []),
    ("Version 3.11.2 came out on 2023-02-08, see page 14.", []),
    ("He ran 10 km in 45:30, at 4.5 minutes each.", []),
    ("Connect the dots. Dot by dot, at last, a face.", []),
    ("They met at ten and left at noon; nothing else happened.", []),
    ("Sections 2.1 and 2.2 cost 30% of 1,250 dollars.", []),
    ("El niño nació en 1984 y vive en la calle Mayor 17.", []),
]


def test_random_field_on_rows_written_by_hand():
    rows = [(t, w) for t, w in BY_HAND if w is not None]
    found = [{(k, t[a:b]) for a, b, k in x} for (t, _), (_, x) in zip(rows, pii.find([t for t, _ in rows], pii.trained()))]
    right, want, got = sum(len(set(w) & f) for (_, w), f in zip(rows, found)), sum(len(w) for _, w in rows), sum(map(len, found))
    assert right / want >= 0.9 and right / got >= 0.9, [(t, f) for (t, w), f in zip(rows, found) if set(w) != f]


def test_decoding_matches_brute_force():
    """Viterbi against all label sequences, with weights looked up by name; decoding in parts against whole texts."""
    from itertools import product

    field = pii.trained()
    for tokens in (["mail", "at", "a"], ["+", "49", "170"], ["x"], ["@", "b", ".", "com"], ["the", "key", "deadbeef00deadbeef00"]):
        e = np.array([field.weights[[field.names[g] for g in f if g in field.names]].sum(axis=0) for f in pii.token_features(tokens)])
        inside, scores, _ = field.emissions([tokens], cut=False)
        assert inside.all() and np.allclose(scores, e)

        def score(y, e=e):
            return field.first[y[0]] + sum(e[t, k] for t, k in enumerate(y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))

        best = max(product(range(len(pii.LABELS)), repeat=len(tokens)), key=score)
        for cut in (True, False):
            assert np.isclose(score(field.decode([tokens], cut)[0]), score(best))
    rng = np.random.default_rng(4)
    words = ["the", "of", ".", "at", "dot", "@", "12", "4111", "-", "+", "(", "Dot", "key", "=", "a1b2c3d4e5f6a7b8c9", "word", "Word", ","]
    texts = [list(rng.choice(words, rng.integers(0, 60), p=[0.2, 0.2, 0.1] + [0.5 / 15] * 15)) for _ in range(300)]
    inside, _, begin = field.emissions(texts)
    assert 0 < inside.mean() < 1
    for a, b in zip(field.decode(texts), field.decode(texts, cut=False), strict=True):
        assert (a == b).all()


def test_personal_data_rows(spark):
    rows = [(1, "Call +1 (017) 555-7713 or st.34@mail7.example.com, version 2.0 of 1999"), (2, None), (3, ""), (None, "at 10.0.0.1 now"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (6, "word " * 50000)]
    df = spark.createDataFrame([(i, t, 9, "s") for i, t in rows], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    assert [s["kind"] for s in got[1]["base"]] == ["phone", "email"] and [s["kind"] for s in got[5]["spans"]] == ["secret"]
    assert not got[2]["spans"] and not got[6]["spans"] and got[None]["base"][0]["kind"] == "ip"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == "Call <PHONE> or <EMAIL>, version 2.0 of 1999" and clean[2] is None and clean[5] == 'token = "<SECRET>"'
    assert pii.redact(df).columns == df.columns and pii.detect(df.limit(0)).count() == 0


def test_quality_on_unseen_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    kept = {r["doc_id"] for r in quality.resample(spark, docs, half, columns=["doc_id"]).collect()}
    rest = [(r["doc_id"], r["quality"]) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [d in kept for d, q in rest if q == 1], [d in kept for d, q in rest if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.05


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 1.0, 4), (2, None, 2.0, 4), (3, "", None, 4), (None, "a b c", 1.0, 4), (1, "a b c", 1.0, 4)], "doc_id long, text string, log_weight double, __id int")
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, quality int")
    out = quality.resample(spark, docs, none)
    assert out.count() == 5 and out.columns == ["doc_id", "text", "__id", "log_weight", "gumbel_key"]
    assert quality.resample(spark, docs.limit(0), none).count() == 0
    assert quality.resample(spark, docs, none, k=2).count() >= 2 and quality.resample(spark, docs, none, k=99).count() == 5


def test_resampling_writes_no_texts(spark, monkeypatch):
    from chronofold.llm.common import Scratch

    save, tables = Scratch.save, []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: tables.append(df) or save(self, df, name))
    docs = spark.createDataFrame([(i % 50, f"w{i % 7} w{i % 11} w{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for k in (None, 20, 99):
        out = quality.resample(spark, docs, labels, k=k)
        few = quality.resample(spark, docs, labels, k=k, columns=["doc_id"])
        assert sorted(out.drop("text").collect()) == sorted(few.collect()) and out.select("text").exceptAll(docs.select("text")).isEmpty()
    assert tables and not any(kind == "string" for df in tables for _, kind in df.dtypes)


def brute_grams(text):
    """Buckets of a text's n-grams, one by one, by the formulas of the module."""
    import zlib

    words, out, mul = (text or "").split(), [], 0x9E3779B97F4A7C15
    h = [zlib.crc32(w.lower().encode()) for w in words]
    s = [2 * (zlib.crc32(quality.shape(w).encode()) & 0xFFFF) + (k > 0 and h[k] == h[k - 1]) for k, w in enumerate(words)]

    def mixed(x):
        return (((x % 2**64) * mul) % 2**64 >> 40) % 8192

    out += [x % 8192 for x in h]
    out += [8192 + mixed(a * 0x100000001B3 + b) for a, b in zip(h, h[1:])]
    out += [16384 + mixed(((a << 17) + b << 17) + c) for a, b, c in zip(s, s[1:], s[2:])]
    return out


def test_resampling_matches_brute_force(spark):
    """Counts, weights, Gumbel noise and the draw, all made again without Spark or numpy arrays."""
    import math
    from collections import Counter

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice", "plain"] if i % 2 else ["BUY", "now!!", "$$$", "plain"], 1 + i % 5))) for i in range(120)]
    rows += [(120, None), (121, ""), (122, " one  long " * 3000)]
    labels = [(i, i % 2) for i in range(0, 120, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = {r["doc_id"]: r["held"] for r in quality.label_sample(spark.createDataFrame(labels, "doc_id long, quality int"), 100).collect()}
    target_ids = {i for i, q in labels if q == 1 and not held[i]}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(brute_grams(t))
        if i in target_ids:
            target.update(brute_grams(t))
    sums = [[sum(n for b, n in c.items() if b // 8192 == t) for t in range(3)] for c in (raw, target)]

    def log_ratio(b):
        p, n = raw[b] / sums[0][b // 8192], sums[1][b // 8192]
        return math.log((target[b] + n * p) / (2 * n * p))

    want = {i: sum(map(log_ratio, brute_grams(t))) * 8 / max(1, len(brute_grams(t))) for i, t in rows}
    got = {r["doc_id"]: r for r in quality.resample(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int"), k=60, passage=8).collect()}
    every = {r["doc_id"]: r for r in quality.resample(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int"), k=10**6, passage=8).collect()}
    assert len(got) == 60 and len(every) == len(rows)
    for i, r in every.items():
        assert abs(r["log_weight"] - want[i]) < 1e-6 * (1 + abs(want[i]))
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel(docs["doc_id"]).alias("g")).collect()}
    assert set(got) == set(sorted(want, key=lambda i: -(want[i] + noise[i]))[:60])
    assert set(got) != set(sorted(want, key=lambda i: -want[i])[:60])  # it is a draw, not a threshold


def test_draws_follow_the_weights(spark):
    """Gumbel top-1 over rows of known weights is a draw in proportion to them."""
    from pyspark.sql import functions as F

    logs = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0)], "id long, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    drawn = logs.withColumn("key", F.col("w") + quality.gumbel(F.col("id"), F.col("seed"))).groupBy("seed").agg(F.max_by("id", "key").alias("id")).groupBy("id").count().collect()
    share = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert all(abs(r["count"] / 4000 - share[r["id"]]) < 0.03 for r in drawn)


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=500).tolist(), *([0.25] * 50), 1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "k double")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 100, 250, len(values)):
        assert quality.kth_largest(df, "k", k) == ranked[k - 1]
    assert quality.kth_largest(df, "k", 0) is None and quality.kth_largest(df, "k", 10**6) is None


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 4, "b": 2, "c": 1}, {"a": 5, "b": 3, None: 1}, {"a": 300, "b": 200, "c": 77}, {"a": 7919, "b": 1}, {f"s{k}": k * k + 1 for k in range(20)}, {"hot": 5000, **{f"s{k}": 300 + 7 * k for k in range(40)}}])
def test_schedule_stays_within_one_block_of_the_weights_as_given(weights):
    total, periods = sum(weights.values()), 1 if sum(weights.values()) > 3000 else 20
    blocks = {s: periods * w for s, w in weights.items()}
    plan = list(mixing.schedule(weights, blocks))
    assert [slot for slot, _, _ in plan] == list(range(periods * total))
    assert mixing.worst_deviation(plan, weights) < 1
    for slot, s, k in plan:
        assert Fraction(k * total, weights[s]) // 1 <= slot < -(-(k + 1) * total // weights[s])


def test_a_source_that_runs_out_leaves_its_slots_empty():
    plan = list(mixing.schedule({"a": 1, "b": 1}, {"a": 2, "b": 5}))
    assert [s for s, _, _ in plan] == [0, 1, 2, 3, 4, 6, 8] and sorted(plan, key=lambda p: p[2])[-1][1] == "b"


def test_mix_keeps_all_rows(spark):
    rows = [(i, "big" if i % 3 else "small", f"t{i}") for i in range(500)] + [(None, "big", "x"), (None, "big", "x"), (7, None, "y"), (7, None, "y")]
    df = spark.createDataFrame([(*r, 5, "mine", 9, 7) for r in rows], "doc_id long, source string, text string, mix_slot int, mix_key string, mix_rank int, __key int")
    got = mixing.mix(spark, df, block_rows=4).collect()
    assert len(got) == len(rows) and {(r["mix_key"], r["mix_rank"], r["__key"]) for r in got} == {("mine", 9, 7)}
    assert len({(r["mix_slot"], r["mix_place"]) for r in got}) == len(rows)
    few = mixing.mix(spark, df, {"big": 3, "small": 2, None: 1}, block_rows=4, max_blocks=20).collect()
    assert len(few) == len(rows) and len({r["mix_slot"] for r in few}) <= 23
    with pytest.raises(ValueError):
        mixing.mix(spark, df, {"big": 1}).count()
    assert mixing.mix(spark, df.limit(0)).count() == 0


def test_mix_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(mixing.ORACLE_SQL).df()
    got = mixing.op6_pfair(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None, 1), (900, "", "en", None, 0, 2), (901, "b " * 9000, None, "src1", 18000, 3)], "doc_id long, text string, lang string, source string, n_chars long, rep int")
    docs = docs.unionByName(nulls, allowMissingColumns=True)
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
    assert counts[0] >= counts[1] == counts[2] == counts[3] <= counts[4]
    text = [r["text"] for r in spark.read.parquet(f"{tmp_path}/2").collect()]
    assert not any(pii.base_spans(t or "") for t in text)
    junk = spark.read.parquet(f"{tmp_path}/0").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("quality = 0").count()
    assert junk <= 2
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
