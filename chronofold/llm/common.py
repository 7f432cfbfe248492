"""Shared ground for the training-data operators: the shared work folder, written
intermediate tables, and connected components.

Everything that has to outlive a stage is written as Parquet below the folder
named by ``spark.checkpoint.dir`` (read from the session), so a lost executor
costs a re-read and never a recomputation from memory that is gone.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.ship import ship_package

__all__ = ["Scratch", "bounded", "components", "delete_path", "shared_dir", "ship_package", "table", "tidy", "unused"]

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What a worker's tasks remember for the tasks after them, by name: how it is forgotten.
REMEMBERED: dict[str, Callable[[], object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronofold-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text in a string column; a single longer text is one slice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give the system back the memory that Arrow and the C library hold but don't use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def forget(but: str | None) -> None:
    """Forget what this worker's tasks remember, but for what is called ``but``."""
    for name, clear in REMEMBERED.items():
        if name != but:
            clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, which gives memory back at its end: workers serve many tasks, and what each leaves adds up.

    What tasks of other operators remember is forgotten before it begins; ``keeps`` names what ``run`` itself remembers.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API; missing ones are fine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting ``key`` is ``value`` for the queries inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Written intermediate tables of one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship_package(spark)
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._quiet_clear)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back: its lineage ends here, and so do the files that it shuffled.

        These go as the write ends; else they stay until the driver happens to collect its garbage. Python functions
        get at most ``batch`` rows at once, where it is given.
        """
        spark = df.sparkSession
        with setting(spark, CLEANUP, "true"), setting(spark, BATCH, str(batch)) if batch else contextlib.nullcontext():
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def _quiet_clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                delete_path(self.spark, self.base)
            except Exception:  # the JVM may be gone when the interpreter ends
                pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_least(edges: DataFrame, least: DataFrame, total: int, hub: int) -> DataFrame:
    """``edges(u, v)`` with ``m`` of ``least(u, m, n)``; nodes of over ``hub`` edges are joined by a broadcast.

    There are at most ``2 * total / hub`` of these, so the broadcast is bounded, and a
    node of any degree stays spread over the tasks that its edges are in.
    """
    if total <= hub:
        return edges.join(least.select("u", "m"), "u")
    hubs = least.where(F.col("n") > hub)
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return rest.select("u", "v", "m").union(edges.join(F.broadcast(hubs.select("u", "m")), "u").select("u", "v", "m"))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, hub: int = 1_000_000) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as ``(id, root)``.

    Alternates the large-star and small-star steps until every node hangs
    directly below the smallest id it can reach. Ids without an edge to another
    id do not appear. Each step is a partially aggregated minimum and a join in
    which nodes of over ``hub`` edges (or a thousandth of all) keep to the tasks of
    their edges; each round is written to the shared folder, which ends its lineage.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e, "cc-0")
    k = 0
    while True:
        state = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("nu")).first()
        if state["n"] == 0 or (state["n"] == state["nu"] and e.select("v").join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0):
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        total, most = state["n"], max(hub, state["n"] // 1000)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, low, total, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"cc-large-{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, total, most).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        nxt = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"cc-{k + 1}")
        scratch.drop(f"cc-{k}", f"cc-large-{k}")
        e, k = nxt, k + 1
