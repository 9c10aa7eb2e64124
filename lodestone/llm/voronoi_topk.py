"""Exact top-k by inner product as a Voronoi kNN join.

A bounded set of pivots splits all vectors into cells. A summary of each cell (how many, how far from the pivot)
bounds every inner product of a query with its members: q.p - |q| r <= q.x <= q.p + |q| r. For each query the k-th
best of the lower bounds is a floor; only cells whose upper bound reaches it can hold a result. Queries are grouped
by pivots of their own into blocks of a bounded number, cells are cut into slices of a bounded number, and a slice is
sent just to the blocks of queries that need its cell. Each block and slice is solved locally with one matrix product.
Which block needs which slice is a table, joined to either side; only what is kept of each pivot reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import Workspace, checked_broadcast, partitions

RESULT = "query_id long, vec_id long, score long"
#: The most pivots, and so cells, at any size.
PIVOTS = 1024
#: Rows (block, cell, slice) that may be broadcast; beyond, they are shuffled.
NEEDS = 100_000


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, the vectors' offsets into them, and which vectors take part.

    A vector takes no part where it or a component is null or not finite, or where a product needs over 63 bits.
    """
    edges = column.offsets.to_numpy().astype(np.int64)
    x = np.floor(scale * pc.fill_null(column.values, np.nan).to_numpy(zero_copy_only=False)[edges[0] : edges[-1]])
    edges -= edges[0]
    fits = np.isfinite(x) & (x >= -(2.0**63)) & (x < 2.0**63)
    bad = np.concatenate([[0], np.cumsum(~fits)])
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (bad[edges[1:]] == bad[edges[:-1]])
    return np.where(fits, x, 0).astype(np.int64), edges, valid


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width), np.int64)
    for i, b in enumerate(raw):
        out[i, : len(b) // 8] = np.frombuffer(b, np.int64)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every sum stays below 2**53."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if big < 2**53 else a @ b.T


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot and the distance to it, rounded up a little."""
    cell, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096].astype(float)
        d = (part**2).sum(1)[:, None] - 2 * part @ pivots.T + (pivots**2).sum(1)
        cell[i : i + 4096] = c = d.argmin(1)
        dist[i : i + 4096] = np.sqrt(((part - pivots[c]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
    return cell, dist


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, scale: float = 1024.0, pivots: int | None = None, block: int = 1024, piece: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products, ties to the smaller vec_id.

    Without ``queries`` (same columns), the rows whose id is divisible by 100 are asked. Each component x counts as
    floor(scale * x). Rows whose id or vector is null, or with null or non-finite components, take no part. A row is
    no candidate of a query of its own id; rows that repeat an id are candidates each, and queries once each distinct
    vector, so such an id's ranks hold for the rows together. Shorter vectors count as padded with zeros. Nor do vectors
    take part of which a component's integer needs over 63 bits. With fewer than k candidates all are returned; an empty
    table gives no rows. Other columns are not read. Without ``pivots`` a quarter of the root of the rows are drawn, 64 at
    least and PIVOTS at most; how many there are changes the work, not the result.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "topk")
    queries = vectors.where(F.col(id_col) % 100 == 0) if queries is None else queries

    def encode(batches):
        for batch in batches:
            ids, (values, edges, valid) = batch.column(0), integers(batch.column(1), scale)
            keep = np.flatnonzero(valid & ids.is_valid().to_numpy(zero_copy_only=False))
            raw = [values[a:b].tobytes() for a, b in zip(edges[keep].tolist(), edges[keep + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(raw, pa.binary())], ["vec_id", "v"])

    view = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(encode, "vec_id long, v binary")
    data = work.write(view(vectors), "data")
    asked = work.write(view(queries).distinct(), "asked")
    result = "query_id long, rank int, vec_id long, score long"
    (n_data, longest), (n_asked, longest_asked) = (df.agg(F.count("*"), F.max(F.length("v"))).first() for df in (data, asked))
    width = max(longest or 0, longest_asked or 0) // 8
    pivots = pivots or min(PIVOTS, max(64, math.isqrt(n_data) // 4))
    if not n_asked or not width:
        return spark.createDataFrame([], result)

    def drawn(df: DataFrame, n: int) -> np.ndarray:
        rows = df.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(n).collect()
        return np.unique(_matrix([bytes(r["v"]) for r in rows], width).astype(float), axis=0)

    centers, hubs = drawn(data, pivots), drawn(asked, max(1, min(pivots, math.ceil(n_asked / block))))

    def assign(points: np.ndarray):
        def run(batches):
            for batch in batches:
                cell, dist = _nearest(_matrix(batch.column(1).to_pylist(), width), points)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(dist)], ["vec_id", "v", "cell", "dist"])

        return run

    placed = work.write(data.mapInArrow(assign(centers), "vec_id long, v binary, cell long, dist double"), "placed")
    work.drop("data")
    summary = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    cells = np.array(sorted(summary))
    held, radius = np.array([summary[c][0] for c in cells]), np.array([summary[c][1] for c in cells])
    middle = centers[cells]

    grouped = asked.mapInArrow(assign(hubs), "vec_id long, v binary, cell long, dist double")
    sizes = {r["cell"]: r["n"] for r in grouped.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    share = lambda sizes, most: F.element_at(F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (int(c), math.ceil(n / most))]), F.col("cell"))
    grouped = work.write(grouped.select("vec_id", "v", F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id", "v"), share(sizes, block))).alias("block")), "grouped")

    def needed(batches):
        """The cells that can hold results of a query, by its own bounds."""
        for batch in batches:
            q = _matrix(batch.column(1).to_pylist(), width).astype(float)
            norm, at = np.sqrt((q**2).sum(1))[:, None], q @ middle.T
            slack = 1e-9 * (np.abs(at) + norm * radius) + 1e-3
            low, high = at - norm * radius - slack, at + norm * radius + slack
            order = np.argsort(-low, axis=1)
            enough = (np.cumsum(held[order], axis=1) > k).argmax(axis=1)  # one more than k, as one may be the query itself
            floor = np.take_along_axis(low, np.take_along_axis(order, enough[:, None], 1), 1)
            floor = np.where(held.sum() > k, floor, -np.inf)
            row, col = np.nonzero(high >= floor)
            names, which = np.unique(np.array(batch.column(2).to_pylist(), object), return_inverse=True)
            pairs = np.unique(which[row] * len(cells) + col)
            yield pa.RecordBatch.from_arrays([pa.array(names[pairs // len(cells)], pa.string()), pa.array(cells[pairs % len(cells)])], ["block", "cell"])

    n_slices = share({c: n for c, (n, _) in summary.items()}, piece)
    wanted = grouped.mapInArrow(needed, "block string, cell long").distinct()
    needs = work.write(wanted.select("block", "cell", F.explode(F.sequence(F.lit(0), n_slices - 1)).alias("slice")), "needs")
    part = F.concat_ws("-", "cell", "slice").alias("part")
    few = checked_broadcast(needs, NEEDS)
    sent = placed.withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), n_slices)).join(few, ["cell", "slice"]).select("vec_id", "v", part, "block")
    asks = grouped.join(few, "block").select("vec_id", "v", part, "block")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, x_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        if len(q_ids) and len(x_ids):
            order = np.argsort(x_ids, kind="stable")
            x_ids, x = x_ids[order], _matrix(right.column("v").to_pylist(), width)[order]
            q = _matrix(left.column("v").to_pylist(), width)
            for i in range(0, len(q), 256):
                scores = _products(q[i : i + 256], x)
                for j, s in enumerate(scores):
                    qid = q_ids[i + j]
                    own = x_ids != qid
                    s, ids = s[own], x_ids[own]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        near = np.flatnonzero(s >= least)
                        near = near[np.argsort(-s[near], kind="stable")][:k]
                    else:
                        near = np.argsort(-s, kind="stable")
                    for column, values in zip(out, (np.full(len(near), qid), ids[near], s[near]), strict=True):
                        column.append(values)
        join = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    n = partitions(spark, n_data, 16 * piece)
    found = asks.repartition(n, "block", "part").groupBy("block", "part").cogroup(sent.repartition(n, "block", "part").groupBy("block", "part")).applyInArrow(solve, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
