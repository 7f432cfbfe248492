"""Exact top-k inner-product search with ball trees.

Rows are dealt to shards of bounded size; each shard becomes one ball tree, kept
as one row of a table. Queries are dealt to blocks. Shards are dealt to a few lanes and
blocks to hands; a task reads the shards of a lane, one after the other, for the
blocks of a hand, and keeps only each query's k best of them; the k best of a query's
tasks are merged. So tasks, and what they hand on for a query, are bounded, and no
pair of a block and a shard is ever written. What prunes a node is the kth score so
far, and from the start the kth score among a sample of all rows, which no kth score
can be below (branch and bound with

    max over a ball of <q, x>  <=  <q, center> + |q| * radius

as the bound of a node; the child with the larger bounds is searched first).
Scores are integer inner products in 64-bit arithmetic; bounds carry a margin
for rounding and cut only what lies strictly below the kth score, so ties by
smaller id survive.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, table

LEAF = 256
NONE, NO_ID = -(2**63) + 1, 2**63 - 1  # where a query has fewer than k candidates so far; the first can be negated


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Ball tree as arrays: per node center, radius, range of rows, children (-1: leaf)."""
    order = np.arange(len(x))
    center, radius, lo, hi, left, right = [], [], [], [], [], []
    xf = x.astype(np.float64)

    def node(a: int, b: int) -> int:
        k = len(center)
        rows = xf[order[a:b]]
        c = rows.mean(axis=0)
        center.append(c)
        radius.append(float(np.sqrt(((rows - c) ** 2).sum(axis=1).max())))
        for to, v in ((lo, a), (hi, b), (left, -1), (right, -1)):
            to.append(v)
        return k

    todo = [node(0, len(x))] if len(x) else []
    while todo:
        k = todo.pop()
        a, b = lo[k], hi[k]
        if b - a <= leaf or radius[k] == 0:
            continue
        rows = xf[order[a:b]]
        far = rows[((rows - center[k]) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
        side = rows @ (other - far)
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(side, mid)]
        left[k], right[k] = node(a, a + mid), node(a + mid, b)
        todo += [left[k], right[k]]
    return {"ids": ids[order], "x": x[order], "center": np.array(center), "radius": np.array(radius), "lo": lo, "hi": hi, "left": left, "right": right}


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them all."""
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


class TopK:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int, sample: tuple[np.ndarray, np.ndarray] | None = None):
        self.query_ids, self.q, self.k = query_ids, q, k
        self.qf = q.astype(np.float64)
        self.norm = np.sqrt((self.qf**2).sum(axis=1))
        self.exact_in_float = float(np.abs(self.qf).sum(axis=1).max(initial=0))
        self.score = np.full((len(q), k), NONE)
        self.id = np.full((len(q), k), NO_ID)
        self.floor = np.full(len(q), NONE)
        if sample is not None and len(sample[0]) >= k and len(q):
            ids, x = sample
            s = self._scores(self.q, x, float(np.abs(x).max(initial=0)))
            s[query_ids[:, None] == ids[None, :]] = NONE
            self.floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]

    def _scores(self, q: np.ndarray, x: np.ndarray, big: float) -> np.ndarray:
        if self.exact_in_float * big < 2.0**52:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)  # whole numbers below 2^52: exact
        return q @ x.T

    def _least(self, who: np.ndarray) -> np.ndarray:
        """What a candidate must reach."""
        return np.maximum(self.score[who, -1], self.floor[who])

    def search(self, tree: dict) -> None:
        if not len(tree["ids"]) or not len(self.q):
            return
        big = float(np.abs(tree["x"]).max(initial=0))
        self.floats = self.exact_in_float * big < 2.0**52
        tree["xf"] = tree["x"].astype(np.float64) if self.floats else None
        self._visit(tree, 0, np.arange(len(self.q)), self._bound(tree, 0, np.arange(len(self.q))))

    def _bound(self, tree: dict, node: int, who: np.ndarray) -> np.ndarray:
        at = self.qf[who] @ tree["center"][node]
        reach = self.norm[who] * tree["radius"][node]
        return at + reach + 1e-6 * (1 + np.abs(at) + reach)

    def _visit(self, tree: dict, node: int, who: np.ndarray, bound: np.ndarray) -> None:
        who = who[bound >= self._least(who)]
        if not len(who):
            return
        if tree["left"][node] < 0:
            self._leaf(tree, node, who)
            return
        sides = [(n, self._bound(tree, n, who)) for n in (tree["left"][node], tree["right"][node])]
        for n, b in sorted(sides, key=lambda s: -s[1].mean()):
            self._visit(tree, n, who, b)

    def _leaf(self, tree: dict, node: int, who: np.ndarray) -> None:
        rows = slice(tree["lo"][node], tree["hi"][node])
        ids = tree["ids"][rows]
        if self.floats:
            s = (self.qf[who] @ tree["xf"][rows].T).astype(np.int64)  # whole numbers below 2^52: exact
        else:
            s = self.q[who] @ tree["x"][rows].T
        s[self.query_ids[who][:, None] == ids[None, :]] = NONE
        s[s < self.floor[who][:, None]] = NONE
        new = (s > NONE).any(axis=1) & (s >= self.score[who, -1:]).any(axis=1)
        who, s = who[new], s[new]
        if not len(who):
            return
        scores = np.concatenate([self.score[who], s], axis=1)
        names = np.concatenate([self.id[who], np.broadcast_to(ids, s.shape)], axis=1)
        names[scores == NONE] = NO_ID
        best = np.lexsort((names, -scores), axis=1)[:, : self.k]
        self.score[who] = np.take_along_axis(scores, best, axis=1)
        self.id[who] = np.take_along_axis(names, best, axis=1)

    def rows(self) -> pd.DataFrame:
        at, rank = np.nonzero(self.score > NONE)
        return pd.DataFrame({"query_id": self.query_ids[at], "rank": (rank + 1).astype(np.int32), "vec_id": self.id[at, rank], "score": self.score[at, rank]})


def top_k(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 8192, block_rows: int = 1024, group: int = 2, sample_rows: int = 2048, lanes: int = 8, tasks: int = 1024, hand: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but itself.

    ``rows`` and ``queries`` have ``vec_id`` and ``v``, arrays of whole numbers. There
    are at most ``lanes`` lanes, of ``group`` shards or more, and ``tasks`` tasks, or as
    many more as keep it to some ``hand`` blocks a task. Defined results: rows with a
    null id, a null or empty vector or a null component take no part; a query's
    candidates are the vectors of its own length; a repeated id is a candidate with
    each of its vectors and one query, with the least of them; ties go to the smaller
    id; fewer than k candidates give fewer rows; an empty table gives an empty result;
    other columns are not read.
    """
    scratch = Scratch(spark, "topk")
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull())
    picked = [F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")]
    rows = scratch.save(rows.where(usable).select(*picked).withColumn("dim", F.size("v")), "rows")
    # a repeated query id is one query, with its least vector
    queries = scratch.save(queries.where(usable).select(*picked).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    counts = [{r["dim"]: r["n"] for r in t.groupBy("dim").agg(F.count("*").alias("n")).collect()} for t in (rows, queries)]  # one row a length of vectors
    shards, blocks = ({d: math.ceil(n / most) for d, n in c.items()} for c, most in zip(counts, (shard_rows, block_rows)))
    # the sample is written first: collected directly, each task would send as many rows to the driver
    drawn = math.ceil(min(1.0, 4 * sample_rows / max(1, sum(counts[0].values()))) * 2**30)
    some = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(2**30)) < drawn).orderBy(F.xxhash64("vec_id", "v")).limit(sample_rows)
    some = scratch.save(some, "sample").collect()
    samples = {d: (np.array([r["vec_id"] for r in some if r["dim"] == d], dtype=np.int64), np.array([r["v"] for r in some if r["dim"] == d], dtype=np.int64)) for d in {r["dim"] for r in some}}

    def parts(numbers: dict[int, int]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in numbers.items() for x in kv)), F.col("dim")), F.lit(0)) if numbers else F.lit(0)

    def dealt(df: DataFrame, numbers: dict[int, int]) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.greatest(parts(numbers), F.lit(1))).cast("int"))

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack(pdf["v"].to_numpy()).astype(np.int64)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_tree(pdf["vec_id"].to_numpy(np.int64), matrix(pdf))
        made["x"] = narrow(made["x"])
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["part"].iloc[0])], "tree": [pickle.dumps(made, 5)]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["part"].iloc[0])], "queries": [pickle.dumps((pdf["vec_id"].to_numpy(np.int64), narrow(matrix(pdf))), 5)]})

    trees = scratch.save(dealt(rows, shards).groupBy("dim", "part").applyInPandas(tree, "dim int, shard int, tree binary"), "trees")
    asked = scratch.save(dealt(queries, blocks).groupBy("dim", "part").applyInPandas(block, "dim int, block int, queries binary"), "blocks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, at, met = {}, None, None
        for pdf in batches:
            for d, n, b, t, q in zip(pdf["dim"], pdf["shard"], pdf["block"], pdf["tree"], pdf["queries"]):
                if (d, n) != at:
                    at, met = (d, n), pickle.loads(t)
                    met["x"] = met["x"].astype(np.int64)
                if (d, b) not in states:
                    ids, v = pickle.loads(q)
                    states[d, b] = TopK(ids, v.astype(np.int64), k, samples.get(d))
                states[d, b].search(met)
        for state in states.values():
            yield state.rows()

    def spread(df: DataFrame, number: str, n: int) -> DataFrame:
        return df.repartitionById(n, F.pmod(F.hash("dim").cast("long") + F.col(number), F.lit(n)).cast("int")).hint("shuffle_replicate_nl")

    # every block of queries meets every shard: that is the search's definition. The product has a task for each lane and
    # hand, which streams the lane's shards past the hand's blocks; both are shuffled once, and pairs exist only in passing
    n_lanes = max(1, min(lanes, math.ceil(sum(shards.values()) / group)))
    n_blocks = sum(blocks.values())
    n_hands = max(1, min(n_blocks, max(tasks // n_lanes, math.ceil(n_blocks / hand))))
    met = spread(trees, "shard", n_lanes).join(spread(asked, "block", n_hands), "dim").select("dim", "shard", "block", "tree", "queries")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch, None)
    spark.conf.set(batch, "2")  # a row holds a whole shard
    try:
        found = scratch.save(met.mapInPandas(search, "query_id long, rank int, vec_id long, score long"), "found")
    finally:
        spark.conf.unset(batch) if before is None else spark.conf.set(batch, before)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a lane
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def op2_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    whole = F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = e.where(whole).select("vec_id", F.transform("e", lambda x: F.floor(x * 64)).alias("v"))
    return top_k(spark, scaled, scaled.where("vec_id % 20 = 0"))


#: Brute force over the same integers; the ranking is exact, so it must agree row by row.
ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
