"""Near-duplicate embeddings through hierarchical navigable small-world graphs.

Vectors with one label are dealt to shards of bounded size, each with its own
graph. Every vector of the label is searched in every shard (blocks of shard
against shard), starting with a beam of ``beam`` nodes. A query whose beam ends
full of links is searched again with a wider beam until it holds something
that isn't one; a whole shard is, while an audit of some queries against brute
force finds links that the graph missed. Links are verified by cosine in double
precision. What leaves a shard is a number of links and one edge per linked
component for each vector, never a list of all pairs.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import Scratch, components, table


class Graph:
    """An HNSW graph over unit vectors, built and searched in batches of numpy operations."""

    def __init__(self, x: np.ndarray, links: int = 16, beam: int = 64, seed: int = 7):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.links, n = links, len(x)
        levels = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(links)).astype(int)
        self.order = np.argsort(-levels, kind="stable")  # nodes of upper layers come first
        self.levels = levels
        self.top = int(levels.max(initial=0))
        self.near = [np.full((n, links * 2 if layer == 0 else links), -1, dtype=np.int32) for layer in range(self.top + 1)]
        done, step = 1, 1
        while done < n:
            batch = self.order[done : done + step]
            self._insert(batch, beam)
            done += len(batch)
            step = min(256, done)

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("bd,bkd->bk", q, self.x[ids])

    def _layer(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for a batch of queries: (ids, similarities), best first, -1 where there is none."""
        rows = np.arange(len(q))[:, None]
        near = self.near[layer]
        seen = np.zeros((len(q), len(self.x) + 1), dtype=bool)
        ids = np.where(start >= 0, start, len(self.x))
        seen[rows, ids] = True
        seen[:, -1] = True
        sims = np.where(start >= 0, self._sims(q, np.where(start >= 0, start, 0)), -np.inf).astype(np.float32)
        ids = start.astype(np.int32)
        opened = ids < 0
        at_once = max(4, min(beam // 8, 64))
        while True:
            waiting = np.where(opened, -np.inf, sims)
            k = min(at_once, waiting.shape[1])
            pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
            live = waiting[rows, pick] > -np.inf
            if not live.any():
                break
            opened[rows, pick] = True
            new = np.where(live[:, :, None], near[ids[rows, pick]], -1).reshape(len(q), -1)
            new = np.where(new < 0, len(self.x), new)
            new[seen[rows, new]] = len(self.x)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = len(self.x)
            seen[rows, new] = True
            width = int((new < len(self.x)).sum(axis=1).max())
            if not width:
                continue
            new.sort(axis=1)
            new = new[:, :width]
            there = new < len(self.x)
            s = np.where(there, self._sims(q, np.where(there, new, 0)), -np.inf).astype(np.float32)
            ids = np.concatenate([ids, np.where(there, new, -1)], axis=1).astype(np.int32)
            sims = np.concatenate([sims, s], axis=1)
            opened = np.concatenate([opened, ~there], axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, opened = ids[rows, keep], sims[rows, keep], opened[rows, keep]
        best = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows, best], sims[rows, best]

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by similarity, up to ``most``: first those nearer to the node than to any chosen one, then the nearest."""
        x = self.x[np.where(ids < 0, 0, ids)]
        between = np.einsum("bid,bjd->bij", x, x)
        closest = np.full(ids.shape, -np.inf, dtype=np.float32)
        chosen = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            take = (ids[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (chosen.sum(axis=1) < most)
            chosen[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        rank = np.where(ids < 0, 2, np.where(chosen, 0, 1))
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, first, axis=1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        q = self.x[batch]
        start = np.full((len(batch), 1), self.order[0], dtype=np.int64)
        mates = q @ q.T
        for layer in range(self.top, -1, -1):
            ids, sims = self._layer(q, start, layer, beam)
            joins = np.flatnonzero(self.levels[batch] >= layer)
            if len(joins):
                own = np.broadcast_to(batch[joins], (len(joins), len(joins))).copy()
                alike = mates[np.ix_(joins, joins)].copy()
                np.fill_diagonal(alike, -np.inf)
                np.fill_diagonal(own, -1)
                both, s = np.concatenate([ids[joins], own], axis=1), np.concatenate([sims[joins], alike], axis=1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :beam]
                both, s = np.take_along_axis(both, best, axis=1), np.take_along_axis(s, best, axis=1)
                chosen = self._diverse(both, s, self.links)
                self.near[layer][batch[joins], : self.links] = chosen
                self._link_back(layer, np.repeat(batch[joins], self.links), chosen.ravel())
            start = ids[:, : max(1, beam // 4)]

    def _link_back(self, layer: int, new: np.ndarray, to: np.ndarray) -> None:
        near = self.near[layer]
        new, to = new[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        new, to = new[by], to[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        # chunks keep the padded table small where a node is linked to by a whole batch
        for k in range(0, len(nodes), 256):
            v, f, c = nodes[k : k + 256], first[k : k + 256], count[k : k + 256]
            extra = np.full((len(v), c.max()), -1, dtype=np.int64)
            for i, (a, m) in enumerate(zip(f, c)):
                extra[i, :m] = new[a : a + m]
            both = np.concatenate([near[v], extra], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, self._sims(self.x[v], np.where(both >= 0, both, 0)), -np.inf).astype(np.float32)
            best = np.argsort(-s, axis=1, kind="stable")[:, : 2 * near.shape[1]]
            near[v] = self._diverse(np.take_along_axis(both, best, axis=1), np.take_along_axis(s, best, axis=1), near.shape[1])

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest ``beam`` nodes of each query; ``own`` gives the queries' nodes where they are in the graph."""
        start = np.full((len(q), 1), self.order[0], dtype=np.int64)
        for layer in range(self.top, 0, -1):
            start = self._layer(q, start, layer, 8)[0][:, :4]
        if own is not None:
            start = np.concatenate([start, own[:, None]], axis=1)
            start[:, :-1][start[:, :-1] == own[:, None]] = -1
        return self._layer(q, start, 0, beam)


def linked(graph: Graph, index: np.ndarray, q: np.ndarray, threshold: float, own: bool, beam: int = 64, audit: int = 128, recall: float = 0.999) -> np.ndarray:
    """Which nodes each query links to, as a table of booleans (both are shards, so it is bounded).

    ``index`` and ``q`` are unit vectors in double precision.
    """
    found = np.zeros((len(q), len(index)), dtype=bool)
    margin = threshold - 1e-4  # the graph computes in single precision

    def exact() -> np.ndarray:
        for k in range(0, len(q), 512):
            found[k : k + 512] = q[k : k + 512] @ index.T >= threshold
        return found

    if len(index) <= 4 * beam:  # a beam would visit most of it
        return exact()
    rng = np.random.default_rng(3)

    def run(who: np.ndarray, beam: int) -> None:
        while len(who):
            beam = min(beam, len(index))
            wide, step = [], max(64, 65536 // beam)
            for k in range(0, len(who), step):
                w = who[k : k + step]
                ids, sims = graph.search(q[w].astype(np.float32), beam, w if own else None)
                close = (sims >= margin) & (ids >= 0)
                found[np.repeat(w, close.sum(axis=1)), ids[close]] = True
                if beam < len(index):
                    wide.append(w[close.sum(axis=1) >= beam])
            who = np.concatenate(wide) if wide else np.array([], dtype=int)
            beam *= 4

    everyone = np.arange(len(q))
    run(everyone, beam)
    while True:
        if own:
            found |= found.T
        some = rng.choice(len(q), min(audit, len(q)), replace=False)
        with_links = np.flatnonzero(found.sum(axis=1) > own)
        if len(with_links):
            some = np.union1d(some, rng.choice(with_links, min(audit, len(with_links)), replace=False))
        truth = q[some] @ index.T >= threshold
        if found[some][truth].sum() >= recall * truth.sum():
            break
        beam *= 2
        if beam >= len(index):
            return exact()
        run(everyone, beam)
    for k in range(0, len(q), 512):  # verify in double precision
        rows, columns = np.nonzero(found[k : k + 512])
        for a in range(0, len(rows), 1 << 15):
            r, c = rows[a : a + (1 << 15)], columns[a : a + (1 << 15)]
            found[k + r, c] = np.einsum("nd,nd->n", q[k + r], index[c]) >= threshold
    return found


def by_root(found: np.ndarray, index: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, root, linked vectors) of each query and component of the index that it links to, some rows at a time."""
    order = np.argsort(index["root"], kind="stable")
    roots, starts = np.unique(index["root"][order], return_index=True)
    copies = index["copies"][order]
    for k in range(0, len(found), 256):
        at = np.flatnonzero(found[k : k + 256].any(axis=1))
        if len(at):
            n = np.add.reduceat(found[k + at][:, order] * copies, starts, axis=1)
            rows, columns = np.nonzero(n)
            yield k + at[rows], roots[columns], n[rows, columns]


def local_roots(found: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component in a symmetric table of links."""
    n = len(found)
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        front = np.array([seed])
        while len(front):
            hit = found[front].any(axis=0) & (root < 0)
            root[hit] = seed
            front = np.flatnonzero(hit)
    return root


def near_duplicates(spark: SparkSession, rows: DataFrame, threshold: float = 0.98, shard_rows: int = 8192, beam: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``rows``.

    Defined results: null labels, null or zero vectors and vectors with a null,
    NaN or infinite component link with nothing; so do vectors of different
    lengths; equal vectors of one label always link; rows with a null id are
    returned with no links and a null component; repeated ids are returned as
    often as they come and are one node for reachability; an empty table gives
    an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "hnsw")
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).alias("label"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    own = scratch.save(own.withColumn("usable", F.coalesce(whole, F.lit(False))), "rows")
    same = own.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    same = scratch.save(same.withColumn("dim", F.size("v")), "distinct")
    shards = same.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = same.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def unit(pdf_v: pd.Series) -> np.ndarray:
        x = np.stack(pdf_v.to_numpy()).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of huge or tiny components leave the range
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x, ids, copies = unit(pdf["v"]), pdf["rep"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        graph = Graph(x, beam=beam)
        found = linked(graph, x, x, threshold, True, beam)
        found |= found.T
        np.fill_diagonal(found, False)
        root = ids[local_roots(found)]
        kept = pickle.dumps({"graph": graph, "x": x, "ids": ids, "copies": copies, "root": root}, 5)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [kept], "ids": [ids], "n": [found @ copies], "root": [root]})

    label_type = own.schema["label"].dataType.simpleString()
    built = dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label_type}, dim int, shard int, graph binary, ids array<long>, n array<long>, root array<long>")
    built = scratch.save(built, "graphs")
    inner = built.select(F.explode(F.arrays_zip("ids", "n", "root")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.n").alias("n"), F.col("r.root").alias("root"))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["graph_a"], pdf["graph_b"]):
                a, b = pickle.loads(a), pickle.loads(b)
                found = linked(a["graph"], a["x"], b["x"], threshold, False, beam)
                found |= linked(b["graph"], b["x"], a["x"], threshold, False, beam).T
                for table_, q, index in ((found, b, a), (found.T, a, b)):
                    for at, root, n in by_root(table_, index):
                        yield pd.DataFrame({"id": q["ids"][at], "n": n, "root": root})

    # rows are shards: each pair of one label's shards meets once, as numbers first; then either shard's graph is
    # joined to it, in as many tasks as the label has shards. Even sums are turned, so that each shard is second in half its pairs
    shard = built.select("label", "dim", "shard")
    pairs = shard.withColumnRenamed("shard", "lo").join(shard.withColumnRenamed("shard", "hi"), ["label", "dim"]).where("lo < hi")
    turned = (F.col("lo") + F.col("hi")) % 2 == 0
    pairs = pairs.select("label", "dim", F.when(turned, F.col("hi")).otherwise(F.col("lo")).alias("sa"), F.when(turned, F.col("lo")).otherwise(F.col("hi")).alias("sb"))
    a, b = (built.select("label", "dim", F.col("shard").alias(f"s{x}"), F.col("graph").alias(f"graph_{x}")) for x in "ab")
    pairs = pairs.join(a.hint("merge"), ["label", "dim", "sa"]).join(b.hint("merge"), ["label", "dim", "sb"]).select("graph_a", "graph_b")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch, None)
    spark.conf.set(batch, "1")  # a row holds two whole shards
    try:
        outer = scratch.save(pairs.mapInPandas(across, "id long, n long, root long"), "across")
    finally:
        spark.conf.unset(batch) if before is None else spark.conf.set(batch, before)
    every = inner.union(outer)
    per_rep = every.groupBy("id").agg(F.sum("n").alias("n"))
    # an id that stands for several vectors is one node
    renamed = own.where("usable").join(same.select("label", "v", "rep", "copies"), ["label", "v"]).select("vec_id", "rep", "copies")
    renamed = scratch.save(renamed, "reps")
    edges = every.where("n > 0").select(F.col("id").alias("u"), F.col("root").alias("v")).union(renamed.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    roots = components(spark, edges, scratch)
    linked_rows = renamed.join(per_rep.withColumnRenamed("id", "rep"), "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rest = own.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked_rows.union(rest).join(roots.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


#: All pairs of one label; the walk over links gives each vector's smallest reachable id.
ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.w, r.root FROM reach r JOIN links l ON l.u = r.vec_id
), least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links,
       component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""
