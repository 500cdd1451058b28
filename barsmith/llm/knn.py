"""Exact top-k search by a Voronoi join on pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, table

#: Pivots: about a quarter of the square root of the number of vectors, between these bounds.
PIVOTS = (16, 1024)
BLOCK_ROWS = 4096
#: Queries that meet a block in one task, about; more are dealt out to as many tasks as needed.
QUERY_ROWS = 20_000
#: Bounds are floating-point; they get this much slack, so that none cuts off a true answer.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; floating-point products are exact while the sums stay under 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and the distance to it."""
    d = (x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots**2).sum(1)[None]
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query row's k highest scores, ties to the smaller id; a query's own row doesn't count."""
    by_id = ids.argsort(kind="stable")
    ids, score = ids[by_id], score[:, by_id]
    out = []
    for i in range(len(query)):
        s = score[i]
        keep = np.flatnonzero(ids != query[i])
        if len(keep) > k:
            edge = np.partition(s[keep], len(keep) - k)[len(keep) - k]
            keep = keep[s[keep] >= edge]
        keep = keep[(-s[keep]).argsort(kind="stable")][:k]
        out.append((np.full(len(keep), query[i]), ids[keep], s[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


PAIRS = "query_id long, vec_id long, score long"


def _solve(k: int) -> Any:
    """Cogrouped: the queries sent to a block of a cell, and the block."""

    def solve(queries: Iterator[pa.RecordBatch], block: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(b.column("id").to_numpy(), _matrix(b.column("vec"))) for b in block if b.num_rows]
        if not data:
            return
        ids, vecs = np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data])
        for b in queries:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                q = part.column("id").to_numpy()
                found = _best(q, ids, _scores(_matrix(part.column("vec")), vecs), k)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return solve


def _table_solve(k: int) -> Any:
    solve = _solve(k)

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out = list(solve(iter(queries.combine_chunks().to_batches()), iter(block.combine_chunks().to_batches())))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches([b for b in out if b.num_rows], schema) if out else schema.empty_table()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "vec", k: int = 10, pivots: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's k highest inner products over all other rows; ties to the smaller id.

    vec_col holds integer arrays. Every vector goes to the cell of its nearest pivot; pivots are a bounded
    sample (the `pivots` rows whose ids hash lowest, collected; by default a quarter of the square root of the
    number of rows, 16 to 1,024). A cell's summary is its row count and radius. In
    cell j a product is at most q.p_j + |q| r_j and at least q.p_j - |q| r_j. First each query is solved in the
    cell with the best upper bound, which gives a floor under its k-th score; the summaries give another: the
    score that cells with k + 1 rows in all can't fall below. Then the query is sent to those other cells only whose
    upper bound reaches the floor. Cells are split into blocks of about block_rows rows by a hash of the id, so
    a hot cell is many tasks; queries are replicated to the blocks, rows are moved once a round.

    Vectors that are null, that hold null, or whose length isn't the table's commonest (ties: the longest) take
    no part. Rows with the query's own id are its own row, so repeated ids don't find each other, and the least of their
    vectors, component by component, is the query; repeated candidates are candidates each. Fewer candidates give fewer rows; an empty table gives none. Other columns don't matter.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("long")).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter("id is not null and vec is not null and not exists(vec, x -> x is null)")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    if length is None or not length["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.filter(F.size("vec") == length["n"])
    if pivots is None:
        pivots = int(min(max(math.sqrt(length["count"]) / 4, PIVOTS[0]), PIVOTS[1]))
    chosen = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = np.unique(np.array([r["vec"] for r in chosen], np.float64), axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, distance = _nearest(_matrix(b.column(1)).astype(np.float64), centres)
                yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(distance)], ["id", "vec", "is_query", "cell", "distance"])

    placed = cut(rows.mapInArrow(assign, "id long, vec array<long>, is_query boolean, cell int, distance double"))
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r")).collect()  # a row a pivot at most
    n_cells = len(centres)
    size, radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for cell, n, r in summary:
        size[cell], radius[cell] = n, r
    blocks = np.maximum(1, -(-size // block_rows))

    def bounds(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = vec.astype(np.float64)
        middle, reach = v @ centres.T, np.linalg.norm(v, axis=1)[:, None] * radius[None]
        slack = SLACK * (1 + np.abs(middle) + reach)
        upper, lower = middle + reach + slack, middle - reach - slack
        upper[:, size == 0] = -np.inf
        lower[:, size == 0] = -np.inf
        return upper, lower

    def send(cells: list[np.ndarray], b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.concatenate([np.full(int(blocks[c].sum()), i) for i, c in enumerate(cells)] or [np.zeros(0)]).astype(np.int64)
        cell = np.concatenate([np.repeat(c, blocks[c]) for c in cells] or [np.zeros(0)]).astype(np.int32)
        block = np.concatenate([np.arange(blocks[x]) for c in cells for x in c] or [np.zeros(0)]).astype(np.int32)
        moved = pa.Table.from_batches([b]).select(["id", "vec"]).take(pa.array(at)).combine_chunks()
        return pa.record_batch([*(moved.column(i).combine_chunks() if moved.num_rows else pa.array([], moved.schema[i].type) for i in range(2)), pa.array(cell), pa.array(block)], ["id", "vec", "cell", "block"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                upper, _ = bounds(_matrix(part.column("vec")))
                yield send([np.array([x]) for x in upper.argmax(1)], part)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                upper, lower = bounds(_matrix(part.column("vec")))
                order = np.argsort(-lower, axis=1)
                reached = np.cumsum(size[order], axis=1) >= k + 1
                at = reached.argmax(1)
                floor = np.where(reached.any(1), np.take_along_axis(lower, order[np.arange(len(order)), at][:, None], 1)[:, 0], -np.inf)
                known = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                floor = np.fmax(floor, known)
                home = upper.argmax(1)
                yield send([np.flatnonzero((u >= f) & (np.arange(n_cells) != h) & (size > 0)) for u, f, h in zip(upper, floor, home, strict=True)], part)

    sent = "id long, vec array<long>, cell int, block int"
    n_blocks = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), F.col("cell") + 1)
    data = placed.select("id", "vec", "cell", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"))
    # of rows with one id the first by its components is the query
    queries = placed.filter("is_query").groupBy("id").agg(F.min("vec").alias("vec"))
    solve = _table_solve(k)

    def joined(q: DataFrame) -> DataFrame:
        # queries of a block are dealt out too, and the block goes with each part
        q = cut(q)
        parts = q.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("parts"))  # a row a block
        key = ["cell", "block", "part"]
        asked = q.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
        held = data.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(solve, PAIRS)

    near = cut(_ranked(joined(queries.mapInArrow(first, sent)), k))
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low").cast("double")).alias("floor"))
    far = joined(queries.join(floors, "id", "left").select("id", "vec", "floor").mapInArrow(rest, sent))
    return _ranked(near.select("query_id", "vec_id", "score").unionAll(far), k).select("query_id", "rank", "vec_id", "score")


def op4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's search: components to floor(1024 x), queries every hundredth id."""
    e = table(spark, sf_dir, "embeddings")
    good = e.filter("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    vectors = good.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double"))).alias("vec"))
    return top_k(vectors, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
