"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's rows are put in a random but fixed order and cut into blocks. For
whole weights w with the sum W, a source's block j may run from slot
``floor(j * W / w)`` (its release) and must run before slot
``ceil((j + 1) * W / w)`` (its deadline). Each slot goes to the released block with
the earliest deadline; then after any number of slots every source has had less
than one block more or less than w / W of them. Weights are taken as they are:
nothing is rounded to a number of slots.

The schedule is made block by block from the sources' numbers of rows. Blocks grow
with the corpus, so that there are at most ``max_blocks`` and one for each source:
the plan is a table of bounded size, and each row finds its slot by a join.

Every row is kept. A source that has run out leaves its later slots empty, and
the others go on in their proportion.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.common import table, unused

MAX_SOURCES = 100_000
MAX_BLOCKS = 1 << 17


def window(block: int, weight: int, total: int) -> tuple[int, int]:
    """(release, deadline) of a source's block."""
    return block * total // weight, -(-(block + 1) * total // weight)


def schedule(weights: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[int, str | None, int]]:
    """Earliest deadline first: (slot, source, which of its blocks), by slot. Ties go by name, null first."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is not None, s))
    waiting = [(0, k, 0) for k, s in enumerate(names) if blocks.get(s, 0)]  # by release
    ready: list[tuple[int, int, int]] = []  # by deadline
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(j, weights[names[k]], total)[1], k, j))
        _, k, j = heapq.heappop(ready)
        yield slot, names[k], j
        slot += 1
        if j + 1 < blocks[names[k]]:
            heapq.heappush(waiting, (window(j + 1, weights[names[k]], total)[0], k, j + 1))


def source_rows(docs: DataFrame, source_col: str) -> dict[str | None, int]:
    """Rows of each source: one entry a source, of which there are at most MAX_SOURCES."""
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name groups of them as sources")
    return {r["s"]: r["n"] for r in rows}


def tempered(rows: dict[str | None, int]) -> dict[str | None, int]:
    """Weights that grow with the square root of a source's number of rows (whole numbers)."""
    return {s: math.isqrt(n) for s, n in rows.items()}


def mix(spark: SparkSession, docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", digits: int = 3, max_blocks: int = MAX_BLOCKS, prefix: str = "mix_") -> DataFrame:
    """``docs`` with ``mix_block, mix_release, mix_deadline, mix_slot, mix_place`` (by ``prefix``); (slot, place) is the mixed order.

    Without ``weights``, those of ``tempered``. Blocks have ``block_rows`` rows, or
    more where there would be over ``max_blocks`` of them. Defined results: null
    sources are one source; sources without a weight are an error, so that no row is
    lost; rows with null or repeated ids are ordered by a hash of the row and keep a
    place each; an empty table gives an empty result; columns of ``docs`` named
    like the added ones are replaced, all others are returned as they are.
    """
    added = block, release, deadline, slot, place = [prefix + c for c in ("block", "release", "deadline", "slot", "place")]
    docs = docs.drop(*added)
    rows = source_rows(docs, source_col)
    weights = tempered(rows) if weights is None else weights
    if not rows:
        return docs.select("*", *(F.lit(None).cast("long").alias(c) for c in added)).limit(0)
    if min(weights.values()) <= 0:
        raise ValueError("weights are positive whole numbers")
    if rows.keys() - weights.keys():
        raise ValueError(f"sources without a weight: {sorted(map(str, rows.keys() - weights.keys()))[:10]}")
    total = sum(weights.values())
    size = max(block_rows, -(-sum(rows.values()) // max_blocks))
    slots: dict[str | None, list[int]] = {s: [] for s in rows}
    for when, s, _ in schedule(weights, {s: -(-n // size) for s, n in rows.items()}):
        slots[s].append(when)

    names = {c: unused([*docs.columns, *added], f"{prefix}{c}") for c in ("key", "weight", "hash", "bucket", "tie", "base", "rank", "n", "line", "at")}
    key, weight, hashed, bucket, tie, base, rank, count, line, at = names.values()

    def known(name: str | None) -> str:
        return "-" if name is None else f"+{name}"

    # one line a source: its name, its weight, the slots of its blocks in order
    lines = ["{} {} {}".format(base64.b64encode(known(s).encode()).decode(), weights[s], ",".join(map(str, slots[s]))) for s in rows]
    parts = F.split(F.col(line), " ")
    plan = spark.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias(line))
    plan = plan.select(F.unbase64(parts[0]).cast("string").alias(key), parts[1].cast("long").alias(weight), F.posexplode(F.split(parts[2], ",")).alias(block, at))
    plan = plan.select(key, weight, F.col(block).cast("long").alias(block), F.col(at).cast("long").alias(slot))

    given = docs.withColumn(key, F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-")))
    given = given.withColumn(hashed, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))).withColumn(bucket, F.substring(hashed, 1, digits)).withColumn(tie, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    # ranks in two steps, so that a source of any size is spread over its buckets
    counts = given.groupBy(key, bucket).agg(F.count("*").alias(count))
    before = Window.partitionBy(key).orderBy(bucket)  # at most 16 ** digits rows each
    bases = counts.select(key, bucket, (F.sum(count).over(before) - F.col(count)).alias(base))
    inside = Window.partitionBy(key, bucket).orderBy(hashed, id_col, tie)
    ranked = given.withColumn(rank, F.row_number().over(inside) - 1).join(bases, [key, bucket]).withColumn(rank, F.col(rank) + F.col(base))
    placed = ranked.withColumn(block, F.expr(f"{rank} div {size}")).join(plan, [key, block])
    return placed.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        block,
        F.expr(f"{block} * {total} div {weight}").cast("long").alias(release),
        F.expr(f"(({block} + 1) * {total} + {weight} - 1) div {weight}").cast("long").alias(deadline),
        slot,
        F.expr(f"{rank} % {size}").cast("long").alias(place),
    )


def worst_deviation(plan: Iterable[tuple[int, str | None, int]], weights: dict[str | None, int]) -> Fraction:
    """The largest difference, in blocks, between what a source has got and what its weight asks for, while all sources last."""
    had, worst, total = dict.fromkeys(weights, 0), Fraction(0), sum(weights.values())
    for slot, s, _ in plan:
        had[s] += 1
        worst = max(worst, *(abs(had[x] - Fraction((slot + 1) * weights[x], total)) for x in weights))
    return worst


def op6_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents").select("doc_id", "source"))


#: The schedule is simulated block by block from the weights as they are; ranks come from one plain window per source.
ORACLE_SQL = """
WITH RECURSIVE counted AS (
  SELECT source, count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM documents GROUP BY source
), sized AS (
  SELECT CAST(greatest(64, (sum(n) + 131071) // 131072) AS BIGINT) AS size, CAST(sum(w) AS BIGINT) AS total FROM counted
), lists AS (
  SELECT list(w ORDER BY source NULLS FIRST) AS w, list(source ORDER BY source NULLS FIRST) AS names,
         list(CAST((n + size - 1) // size AS BIGINT) ORDER BY source NULLS FIRST) AS blocks, any_value(total) AS total
  FROM counted, sized
), steps(slot, done, pick, nth) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(w, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT now, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p, done[p]
  FROM (
    SELECT now, done, CAST(list_min(list_transform(list_filter(open, lambda i: done[i] * total // w[i] <= now),
        lambda i: ((done[i] + 1) * total + w[i] - 1) // w[i] * 100000 + i)) % 100000 AS BIGINT) AS p
    FROM (
      SELECT done, open, total, w, greatest(slot + 1, list_min(list_transform(open, lambda i: done[i] * total // w[i]))) AS now
      FROM (SELECT slot, done, total, w, list_filter(range(1, len(done) + 1), lambda i: done[i] < blocks[i]) AS open FROM steps, lists)
      WHERE len(open) > 0
    )
  )
), plan AS (
  SELECT slot, names[pick] AS source, nth FROM steps, lists WHERE slot >= 0
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents
)
SELECT d.doc_id, d.source, CAST(p.nth AS BIGINT) AS mix_block, CAST(p.nth * z.total // c.w AS BIGINT) AS mix_release,
       CAST(((p.nth + 1) * z.total + c.w - 1) // c.w AS BIGINT) AS mix_deadline,
       CAST(p.slot AS BIGINT) AS mix_slot, CAST(d.r % z.size AS BIGINT) AS mix_place
FROM ranked d JOIN sized z ON true JOIN counted c ON c.source IS NOT DISTINCT FROM d.source
JOIN plan p ON p.source IS NOT DISTINCT FROM d.source AND p.nth = d.r // z.size
"""
