"""Exact search of a stated set of query vectors against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    array = column.combine_chunks()
    taken = array.take(pa.array(rows))
    x = taken.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = x.reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    return x


def _block(table: pa.Table, k: int | None, least: float) -> pa.Table:
    side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
    a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(a) and len(b):
        b = b[np.argsort(ids[b], kind="stable")]
        y = _matrix(table.column("vector"), b)
        ny = np.sqrt((y * y).sum(1))
        for part in np.array_split(a, max(1, len(a) // 256)):
            x = _matrix(table.column("vector"), part)
            nx = np.sqrt((x * x).sum(1))
            norm = nx[:, None] * ny[None, :]
            score = np.divide(x @ y.T, norm, out=np.full(norm.shape, -1.0), where=norm > 0)
            score[ids[part][:, None] == ids[b][None, :]] = -2
            order = np.argsort(-score, axis=1, kind="stable")[:, : k if k else score.shape[1]]
            best = np.take_along_axis(score, order, 1)
            ok = (best >= least) & (best > -1)
            q, at = np.nonzero(ok)
            parts.append((ids[part][q], ids[b][order[q, at]], best[q, at]))
    q, i, s = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts) if parts else ((), (), ())))
    return pa.table({"query_id": pa.array(q.astype(np.int64)), "id": pa.array(i.astype(np.int64)), "cosine": pa.array(s.astype(float))})


def cosine_search(index: DataFrame, queries: DataFrame, k: int | None = None, least: float = -1.0, block: int = BLOCK) -> DataFrame:
    """query_id, id, cosine (and rank with ``k``): the vectors most similar to each query, or all of at least ``least``.

    ``index`` and ``queries``: id, vector (arrays of numbers, all of one length). Both sides are cut into blocks, and each pair of blocks is one matrix
    product in a task that returns only its best; no pair of rows is ever shuffled. Equal cosines rank by id; a query doesn't find itself.
    Null and empty vectors are left out.
    """
    usable = "id is not null and vector is not null and size(vector) > 0"
    rows, asked = index.where(usable).select("id", "vector"), queries.where(usable).select("id", "vector")
    n_rows, n_asked = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // block))
    stored = rows.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).withColumn("side", F.lit(0))
    wanted = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_asked)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).withColumn("side", F.lit(1))
    both = stored.select("xb", "qb", "side", "id", "vector").unionByName(wanted.select("xb", "qb", "side", "id", "vector"))
    found = both.groupBy("xb", "qb").applyInArrow(lambda t: _block(t, k, least), "query_id long, id long, cosine double")
    if k is None:
        return found
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
