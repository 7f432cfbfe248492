"""Top-k search and embedding near-duplicates against brute force."""

import duckdb
import numpy as np
import pytest

from chronofold.llm import hnsw, topk

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def brute_top_k(rows, queries, k):
    out = []
    for q, v in sorted(queries):
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("sample", [0, 50])
@pytest.mark.parametrize("scale", [3, 10**8])  # many ties; products beyond exact doubles
def test_top_k_matches_brute_force(spark, scale, sample):
    rng = np.random.default_rng(0)
    rows = [(i, list(map(int, rng.integers(-scale, scale + 1, 5)))) for i in range(300)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, v array<long>, part int, tree string")
    nulls = spark.createDataFrame([(None, [1] * 5), (900, None), (901, [1, None, 1, 1, 1])], "vec_id long, v array<long>")
    both = df.unionByName(nulls, allowMissingColumns=True)
    got = topk.top_k(spark, both, both.where("vec_id % 20 = 0"), k=4, shard_rows=32, block_rows=6, sample_rows=sample)
    assert rows_of(got) == brute_top_k(rows, [r for r in rows if r[0] % 20 == 0], 4)


def test_top_k_of_vectors_of_several_lengths(spark):
    rows = [(i, [i, 1, 2][: 1 + i % 3]) for i in range(60)] + [(100, []), (101, None), (7, [5, 5]), (7, [5, 5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    own = [(i, v) for i, v in rows if v]
    asked = {}
    for i, v in own:
        asked[i] = min(asked.get(i, v), v)
    want = [r for i, v in asked.items() for r in brute_top_k([(j, w) for j, w in own if len(w) == len(v)], [(i, v)], 3)]
    assert rows_of(topk.top_k(spark, df, df, k=3, shard_rows=5, block_rows=4, sample_rows=9)) == sorted(want)


def test_top_k_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, v array<long>")
    assert rows_of(topk.top_k(spark, few, few, k=20)) == [(0, 1, 1, 11), (1, 1, 0, 11)]
    assert topk.top_k(spark, few.limit(0), few.limit(0)).count() == 0


def stages_of(spark, group, run):
    """The last attempts of the stages that ``run`` ran in."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = sc.statusTracker()
    ran = sorted({s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)})
    return out, [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in ran]


def test_top_k_of_many_shards_and_blocks_has_a_bounded_number_of_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, list(map(int, rng.integers(-9, 10, 4)))) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    queries = [r for r in rows if r[0] % 20 == 0]
    want = brute_top_k(rows, queries, 4)
    got, stages = stages_of(spark, "many", lambda: rows_of(topk.top_k(spark, df, df.where("vec_id % 20 = 0"), k=4, shard_rows=3, block_rows=1)))
    assert got == want
    assert 50 < max(s.numTasks() for s in stages) <= 1024  # 200 shards and 30 blocks: 3,000 in twos
    assert rows_of(topk.top_k(spark, df, df.where("vec_id % 20 = 0"), k=4, shard_rows=3, block_rows=1, lanes=3, tasks=6)) == want  # several blocks a task
    assert rows_of(topk.top_k(spark, df, df.where("vec_id % 20 = 0"), k=4, shard_rows=3, block_rows=1, lanes=1, tasks=1, hand=7)) == want


def test_top_k_sends_the_driver_one_sample_however_many_tasks_read(spark):
    df = spark.range(20_000).selectExpr("id as vec_id", "transform(sequence(1, 8), k -> pmod(hash(id, k), 100)) as v").repartition(16)
    most = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(most)
    spark.conf.set(most, "32k")  # a task a file
    try:
        got, stages = stages_of(spark, "sample", lambda: topk.top_k(spark, df, df.where("vec_id % 20 = 0 and vec_id < 400"), k=3).count())
    finally:
        spark.conf.set(most, before)
    assert got == 60
    assert max(s.numTasks() for s in stages) >= 16
    assert max(s.resultSize() for s in stages) < 1_000_000  # 2,048 rows of some 120 bytes, and the tasks' figures


def test_graph_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph(x)
    q = rng.normal(size=(50, 24)).astype(np.float32)
    ids, _ = g.search(q, 64)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :10], truth)])
    assert recall >= 0.9


def test_dense_and_small_shards_lose_no_link():
    rng = np.random.default_rng(9)
    x = rng.normal(size=8) + rng.normal(size=(600, 8)) * 0.05  # most pairs link
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in (5, 200, 600):
        g = hnsw.Graph(x[:n], beam=8)
        found = hnsw.linked(g, x[:n], x[:n], 0.98, True, beam=8)
        truth = x[:n] @ x[:n].T >= 0.98
        assert (found | found.T)[truth].mean() >= 0.999 and not found[~truth].any()
    index = {"root": np.array([4, 4, 9, 4, 9]), "copies": np.array([1, 2, 3, 4, 5])}
    got = [(int(q), int(r), int(n)) for at in hnsw.by_root(np.array([[1, 0, 0, 1, 1], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]], dtype=bool), index) for q, r, n in zip(*at)]
    assert got == [(0, 4, 5), (0, 9, 5), (2, 4, 7), (2, 9, 8)]


def brute_links(rows):
    links = {i: set() for i, _, _ in rows}
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a is not None and a == b and v and w and all(x is not None and np.isfinite(x) for x in v + w) and any(v) and any(w) and len(v) == len(w):
                if np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                    links[i].add(j)
    root = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += links[j]
    return sorted((i, len(links[i]), root[i], root[i] == i) for i in links)


def test_near_duplicates_match_brute_force_over_shards(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(320):
        v = base[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.12)
        rows.append((i, [float(np.float32(x)) for x in v], [1, 1, 2, None][i % 4]))
    rows += [(1000 + k, rows[0][1], 1) for k in range(30)]  # equal vectors
    rows += [(2000, [0.0] * 16, 1), (2001, None, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [1.0] * 15, 1), (2004, [None] + [1.0] * 15, 1), (2005, [1.0, 2.0], 1), (2006, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(i, v, a, 1, "y") for i, v, a in rows], "vec_id long, embedding array<double>, label int, rep int, n string")
    assert rows_of(hnsw.near_duplicates(spark, df, shard_rows=50)) == brute_links(rows)
    none = spark.createDataFrame([(None, [1.0, 0.0], 1)], df.select("vec_id", "embedding", "label").schema)
    assert [tuple(r) for r in hnsw.near_duplicates(spark, none).collect()] == [(None, 0, None, False)]
    assert hnsw.near_duplicates(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("query, sql", [(topk.op2_ball_tree, topk.ORACLE_SQL), (hnsw.op7_hnsw, hnsw.ORACLE_SQL)])
def test_queries_match_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(sql).df()
    got = query(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
