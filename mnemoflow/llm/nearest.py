"""Problem 5: the most similar vectors of every vector, by multi-probe p-stable hashing on two levels.

A vector of length one is projected on random Gaussian directions, and each projection is cut into cells of a fixed width; the cells of
some directions make a bucket, and there are several such tables. A vector is stored in its own bucket of each table. As a query it also
visits the buckets that a near vector most likely fell into: those across the nearest borders, in the order of the success probability that the
distances to the borders give, over all tables at once.

The first level is coarse: vectors are sent to the few buckets that they visit, so what is shuffled is a vector's bytes times a number that
grows by two whenever its kind becomes twice as large. The second level is within a task: a coarse bucket's stored vectors are hashed again, finely, and its visitors,
read one batch after the other, are compared with them by matrix products. Nothing but the best of the compared leaves the task, with their exact cosines.
Exact copies are one class throughout, so that no group of copies is expanded into pairs.

Hashing finds what is alike; most of a vector's ten nearest are not, and for those :func:`top_similar` compares all vectors of a kind, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoflow.llm.codepoints import mix


@dataclass(frozen=True)
class ProbeParams:
    """Parameters of the index; the widths of both levels follow the number of vectors. A higher recall asks for more tables or visits."""

    k: int = 10
    resembling: float = 0.49  # without another bound, pairs of a lower cosine are no candidates
    cell: float = 3.5  # in units of the projections' deviation; a third of a projection's range
    offset: float = 0.15  # cell borders are shifted at random by up to this much about the centre
    coarse_tables: int = 2
    coarse_rows: int = 1 << 18  # vectors that a coarse bucket holds on average, at most about 1.5 times as many
    spread: int = 1 << 11  # small kinds have as many as eight coarse buckets of at least this size, so that they are spread
    coarse_visits: int = 6  # over all tables, own buckets included; two for each direction where that is more
    fine_tables: int = 3
    fine_rows: int = 256
    fine_visits: int = 24
    dense: int = 1 << 19  # stored vectors from which a coarse bucket's visitors are cut into blocks
    block: int = 1 << 18
    seed: int = 20240501


def decoded(embedding_q: Column) -> Column:
    """Bytes of a base64 value, line breaks ignored; null where it can't be decoded."""
    return F.try_to_binary(F.regexp_replace(embedding_q, "[\\r\\n]", ""), F.lit("base64"))


def usable_vectors(fragments: DataFrame) -> DataFrame:
    """frag_id, kind, vec of the records that take part.

    Out are records without model, with a vector that can't be decoded, is empty or all zero, or whose length isn't embedding_dims
    where that is given. The kind is the model and the number of bytes. Extra columns are ignored. A frag_id may come more than once.
    """
    rows = fragments.where("frag_id is not null and embedding_model is not null and embedding_q is not null")
    rows = rows.select("frag_id", "embedding_model", "embedding_dims", "embedding_q")
    rows = rows.withColumn("vec", decoded(F.col("embedding_q")))
    fits = F.col("embedding_dims").isNull() | (F.col("embedding_dims") == F.length("vec"))
    rows = rows.where((F.length("vec") > 0) & fits & (F.regexp_replace(F.hex("vec"), "0", "") != ""))
    return rows.select("frag_id", F.struct("embedding_model", F.length("vec").alias("n")).alias("kind"), "vec")


@lru_cache(64)
def _directions(dims: int, width: int, tables: int, level: int, p: ProbeParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([p.seed, dims, width, level])
    return rng.standard_normal((dims, tables * width)).astype(np.float32), rng.uniform(-p.offset, p.offset, tables * width).astype(np.float32)


def _buckets(x: np.ndarray, salt: np.uint64, width: int, tables: int, visits: int, level: int, p: ProbeParams) -> tuple[np.ndarray, np.ndarray]:
    """Own buckets (n, tables) and visited ones (n, visits) of vectors of length one, the own among them. No two tables share a bucket."""
    n = len(x)
    with np.errstate(over="ignore"):
        start = mix(salt + np.arange(tables, dtype=np.uint64))
        if not width:
            own = np.repeat(start[None, :1], n, 0)
            return own, own
        a, b = _directions(x.shape[1], width, tables, level, p)
        place = ((x @ a + b) / np.float32(p.cell)).reshape(n, tables, width)
        at = np.floor(place)
        down = place - at
        weight = mix(np.arange(17, 17 + tables * width, dtype=np.uint64)).reshape(tables, width) | np.uint64(1)
        own = start + (at.astype(np.int64).astype(np.uint64) * weight).sum(2, dtype=np.uint64)
        cost = np.minimum(down, 1 - down) ** 2
        most = min(6, width)  # borders that are crossed at once or alone
        near = np.argsort(cost, axis=2)[:, :, :most]
        step = np.take_along_axis(np.where(down < 0.5, np.uint64(0) - weight, weight), near, 2)
        sets = (np.arange(1 << most)[:, None] >> np.arange(most)) & 1
        total = (np.take_along_axis(cost, near, 2) @ sets.T.astype(np.float32)).reshape(n, -1)
        visits = min(visits, total.shape[1])
        total[:, :: 1 << most] = -1  # the own buckets
        pick = np.argpartition(total, visits - 1, axis=1)[:, :visits]
        table, moves = pick >> most, pick & ((1 << most) - 1)
        visited = np.take_along_axis(own, table, 1)
        for i in range(most):
            visited = visited + step[np.arange(n)[:, None], table, i] * sets[moves, i].astype(np.uint64)
        return mix(own), mix(visited)


def _matrix(vec: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The int8 vectors of the rows, which have one length, as floats of length one."""
    x = np.stack([np.frombuffer(vec[int(i)].as_py(), np.int8) for i in rows]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coarse(batch: pa.RecordBatch, p: ProbeParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch with their own and visited coarse buckets, a kind and a slice at a time."""
    kinds, sizes, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind_key", "n", "width"))
    for kind in np.unique(kinds):
        for dims in np.unique(sizes[kinds == kind]):
            rows = np.flatnonzero((kinds == kind) & (sizes == dims))
            width = int(widths[rows[0]])
            for part in np.array_split(rows, -(-len(rows) // 2048)):
                yield part, *_buckets(_matrix(batch.column("vec"), part), np.int64(kind).astype(np.uint64), width, p.coarse_tables, max(p.coarse_visits, 2 * width), 0, p)


def _homes(batches: Iterator[pa.RecordBatch], p: ProbeParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, own, _ in _coarse(batch, p):
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64).ravel())], ["bucket"])


def _visits(batches: Iterator[pa.RecordBatch], p: ProbeParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, own, visited in _coarse(batch, p):
            row, at = np.nonzero(np.ones(visited.shape, bool))
            home = (visited[:, :, None] == own[:, None, :]).any(2)[row, at]
            pick = pa.array(part[row])
            columns = [pa.array(visited[row, at].view(np.int64)), pa.array(home), batch.column("cid").take(pick), batch.column("vec").take(pick)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "home", "cid", "vec"])


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Whether a place of a matrix is among the k highest of its row that are above -2; equal ones rank by column."""
    if score.shape[1] <= k:
        return score > -2
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    out = np.zeros(score.shape, bool)
    np.put_along_axis(out, order, True, 1)
    return out & (score > -2)


def _dense_group(table: pa.Table, k: int, most: int) -> pa.Table:
    """Not part of the queries any more, kept for its test. Of one block the pairs that resemble in their sketches and are among the visitor's or the stored vector's best k, by exact cosine: a < b."""
    side, ids = table.column("side").to_numpy(), table.column("cid").to_numpy()
    vec = table.column("vec").combine_chunks()
    sketch = np.stack([table.column(c).to_numpy() for c in ("s", "t")], 1).view(np.uint64)
    stored, asked = (rows[np.argsort(ids[rows], kind="stable")] for rows in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(stored) and len(asked):
        x = _matrix(vec, stored)
        near, who = np.zeros((len(stored), 0), np.float32), np.zeros((len(stored), 0), np.int64)
        for part in np.array_split(asked, max(1, len(asked) // 512)):
            score = _matrix(vec, part) @ x.T
            differ = sum(np.bitwise_count(sketch[part, i][:, None] ^ sketch[stored, i][None, :]).astype(np.int16) for i in (0, 1))
            score[(ids[part][:, None] == ids[stored][None, :]) | (differ > most)] = -2
            q, at = np.nonzero(_best(score, k))
            a_out.append(ids[part[q]])
            b_out.append(ids[stored[at]])
            near, who = np.concatenate((near, score.T), 1), np.concatenate((who, np.broadcast_to(ids[part], score.T.shape)), 1)
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            near, who = np.take_along_axis(near, top, 1), np.take_along_axis(who, top, 1)
        place, at = np.nonzero(near > -2)
        a_out.append(who[place, at])
        b_out.append(ids[stored[place]])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


class _Lists:
    """The best k of each row: other ids by exact cosine, equal ones by id, each once."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.parts = k, 0, []

    def add(self, row: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> None:
        self.parts.append((row, other, cosine))
        self.held += len(row)
        if self.held > 1 << 20:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, other, cosine = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((other, -cosine, row))
        row, other, cosine = row[order], other[order], cosine[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
        row, other, cosine = row[once], other[once], cosine[once]
        top = np.arange(len(row)) - np.searchsorted(row, row, "left") < self.k
        self.parts = [(row[top], other[top], cosine[top])]
        self.held = 0
        return self.parts[0]


def _hits(score: np.ndarray, floor: np.float32, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of at least the floor; where they are many, of those only such as may be among the k best of their row or column, equal ones all."""
    keep = score >= floor
    if np.count_nonzero(keep) > 4 * k * sum(score.shape):
        row, column = (np.partition(score, -min(k, score.shape[i]), axis=i).take(-min(k, score.shape[i]), axis=i) for i in (1, 0))
        keep &= (score >= row[:, None] - np.float32(2e-5)) | (score >= column[None, :] - np.float32(2e-5))
    return np.divmod(np.flatnonzero(keep), score.shape[1])  # faster than nonzero of a matrix


class _Bucket:
    """A coarse bucket: its stored vectors, finely hashed, and the lists of pairs found so far."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, p: ProbeParams, least: float) -> None:
        self.p, self.ids, self.ints, self.least = p, ids, ints, least
        self.x, self.square = _unit(ints), np.einsum("ij,ij->i", ints, ints, dtype=np.int64)
        few = len(ids) <= p.fine_rows * p.fine_visits  # as many would be compared anyway
        self.width = 0 if few else max(1, round(math.log2(len(ids) / p.fine_rows)))
        own = np.concatenate([self.fine(self.x[a : a + 2048])[0] for a in range(0, len(ids), 2048)])
        order = np.argsort(own, axis=None, kind="stable")
        self.rows = order // own.shape[1]
        self.keys, start = np.unique(own.ravel()[order], return_index=True)
        self.starts = np.append(start, len(order))
        self.lists = _Lists(p.k)

    def fine(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _buckets(x, np.uint64(0), self.width, self.p.fine_tables, self.p.fine_visits, 1, self.p)

    def pairs(self, ints: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Asked rows, stored rows, cosines; a pair may come more than once."""
        x, square = _unit(ints), np.einsum("ij,ij->i", ints, ints, dtype=np.int64)
        visited = np.concatenate([self.fine(x[a : a + 2048])[1] for a in range(0, len(x), 2048)])
        at = np.minimum(np.searchsorted(self.keys, visited), len(self.keys) - 1)
        asked, _ = there = np.nonzero(self.keys[at] == visited)
        at = at[there]
        order = np.argsort(at, kind="stable")
        at, asked = at[order], asked[order]
        found, starts = [], np.flatnonzero(np.diff(at, prepend=-1))
        floor = np.float32(self.least - 2e-5)
        for a, b in zip(starts, np.append(starts[1:], len(at))):
            stored = self.rows[self.starts[at[a]] : self.starts[at[a] + 1]]
            for q in np.array_split(asked[a:b], -(-(b - a) // 1024)):
                for s in np.array_split(stored, -(-len(stored) // 8192)):
                    r, c = _hits(x[q] @ self.x[s].T, floor, self.p.k + 1)  # itself is among them
                    found.append(q[r] * len(self.ids) + s[c])
                    if sum(map(len, found[-64:])) > 1 << 20:
                        yield from self.exact(found, ints, square, ids)
                        found = []
        if found:
            yield from self.exact(found, ints, square, ids)

    def exact(self, found: list[np.ndarray], ints: np.ndarray, square: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        codes = np.unique(np.concatenate(found))
        for a in range(0, len(codes), 1 << 15):
            q, s = np.divmod(codes[a : a + (1 << 15)], len(self.ids))
            other = ids[q] != self.ids[s]
            q, s = q[other], s[other]
            cosine = np.einsum("ij,ij->i", ints[q], self.ints[s], dtype=np.int64) / np.sqrt(square[q] * self.square[s].astype(float))
            near = cosine >= self.least
            yield q[near], s[near], cosine[near]

    def ask_stored(self, rows: np.ndarray) -> None:
        for part in np.array_split(rows, -(-len(rows) // 16384)) if len(rows) else []:
            for q, s, cosine in self.pairs(self.ints[part], self.ids[part]):
                self.lists.add(part[q], self.ids[s], cosine)
                self.lists.add(s, self.ids[part[q]], cosine)

    def ask(self, ids: np.ndarray, ints: np.ndarray) -> pa.RecordBatch:
        lists = _Lists(self.p.k)
        for q, s, cosine in self.pairs(ints, ids):
            lists.add(q, self.ids[s], cosine)
            self.lists.add(s, ids[q], cosine)
        row, other, cosine = lists.best()
        return _near_batch(ids[row], other, cosine)

    def of_stored(self) -> pa.RecordBatch:
        row, other, cosine = self.lists.best()
        return _near_batch(self.ids[row], other, cosine)


def _near_batch(cid: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(other, pa.int64()), pa.array(cosine, pa.float64())], ["cid", "other", "cosine"])


def _compare(batches: Iterator[pa.RecordBatch], p: ProbeParams, least: float) -> Iterator[pa.RecordBatch]:
    """The best k of a bucket's stored vectors for each visitor, and the reverse. Rows come by bucket and block, first the stored (side 0, those that ask 1), then the others (2)."""
    current: tuple[int, int] | None = None
    bucket: _Bucket | None = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # side, id, vector

    def work(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal bucket, held
        if not held and bucket is None:
            return
        if held:
            side, ids, ints = (np.concatenate(x) for x in zip(*held))
            held = []
            if bucket is None and (side < 2).any():
                stored = side < 2
                bucket = _Bucket(ids[stored], ints[stored], p, least)
                bucket.ask_stored(np.flatnonzero(side[stored] == 1))
                side, ids, ints = side[~stored], ids[~stored], ints[~stored]
            if bucket is not None and len(ids):
                yield bucket.ask(ids, ints)
        if end and bucket is not None:
            yield bucket.of_stored()
            bucket = None

    for batch in batches:
        key, block, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "block", "side", "cid"))
        vec = batch.column("vec")
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | ((np.diff(side) > 0) & (side[1:] == 2))) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, len(key))):
            if a == b:
                continue
            if current != (key[a], block[a]):
                yield from work(True)
                current = (key[a], block[a])
            elif held and side[a] == 2 and (bucket is None or sum(len(x) for x, *_ in held) >= 16384):
                yield from work(False)
            held.append((side[a:b], ids[a:b], np.frombuffer(b"".join(vec.slice(a, b - a).to_pylist()), np.int8).reshape(b - a, -1)))
    yield from work(True)


def near_classes(classes: DataFrame, p: ProbeParams = ProbeParams(), least: float | None = None) -> DataFrame:
    """Of classes (cid, kind_key, n, vec) the k nearest of those that share a visited bucket: cid, other, cosine.

    Coarse buckets of more than ``dense`` vectors get their visitors in blocks, each in a task of its own with all the stored, so the lists are the same either way.
    """
    least = p.resembling if least is None else least
    # vec is looked at so that the shuffles of the classes are of the same columns, and made once
    kinds = classes.groupBy("kind_key", "n").agg(F.count("*").alias("size"), F.max(F.length("vec")).alias("_n")).where("_n > 0")
    few = F.least(F.lit(3.0), F.floor(F.log2(F.col("size") / p.spread)))
    width = F.greatest(F.lit(0.0), few, F.round(F.log2(F.col("size") / p.coarse_rows))).cast("int")
    sized = classes.join(F.broadcast(kinds.select("kind_key", "n", width.alias("width"))), ["kind_key", "n"]).select("cid", "kind_key", "n", "vec", "width")
    homes = sized.mapInArrow(lambda it: _homes(it, p), "bucket long")
    crowded = homes.groupBy("bucket").count().where(F.col("count") > p.dense).select("bucket", F.ceil(F.col("count") / p.block).cast("int").alias("blocks"))
    rows = sized.mapInArrow(lambda it: _visits(it, p), "bucket long, home boolean, cid long, vec binary").join(F.broadcast(crowded), "bucket", "left")
    own = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")
    blocks = F.when(F.col("home"), F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array(own))
    rows = rows.select("bucket", F.explode(blocks).alias("block"), own.alias("_own"), "home", "cid", "vec")
    rows = rows.withColumn("side", F.when(~F.col("home"), 2).when(F.col("block") == F.col("_own"), 1).otherwise(0)).drop("_own", "home")
    met = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side")
    found = met.mapInArrow(lambda it: _compare(it, p, least), "cid long, other long, cosine double")
    best = Window.partitionBy("cid").orderBy(F.col("cosine").desc(), "other")
    once = found.repartition("cid").dropDuplicates(["cid", "other", "cosine"])
    return once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= p.k).drop("_r")


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): frag_id, cid of every vector, and cid, kind_key, n, vec of every distinct one; cid is the smallest frag_id."""
    key = F.unhex(F.md5(F.concat(F.to_json("kind").cast("binary"), F.col("vec")))).alias("vec_key")
    keyed = vectors.select("frag_id", "kind", "vec", key)
    chosen = keyed.groupBy("frag_id").agg(F.min("vec_key").alias("vec_key"))
    heads = chosen.groupBy("vec_key").agg(F.min("frag_id").alias("cid"))
    members = chosen.join(heads, "vec_key").select("frag_id", "cid")
    shapes = keyed.groupBy("vec_key").agg(F.first("kind").alias("kind"), F.first("vec").alias("vec"))
    return members, shapes.join(heads, "vec_key").select("cid", F.xxhash64("kind").alias("kind_key"), F.col("kind.n").alias("n"), "vec")


def _best_of_block(table: pa.Table, k: int) -> pa.Table:
    """The k nearest stored vectors of each asked one, by exact cosine, equal ones by id: cid, other, cosine."""
    side, ids = table.column("side").to_numpy(), table.column("cid").to_numpy()
    stored, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    stored = stored[np.argsort(ids[stored], kind="stable")]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(stored) and len(asked):
        vec = table.column("vec").combine_chunks()
        ints = np.frombuffer(b"".join(vec.to_pylist()), np.int8).reshape(len(ids), -1)
        y_ids, y = ids[stored], _unit(ints[stored])
        square = np.concatenate([(part.astype(float) ** 2).sum(1) for part in np.array_split(ints, -(-len(ids) // 4096))])
        for part in np.array_split(asked, -(-len(asked) // 256)):
            x, own = _unit(ints[part]), np.searchsorted(y_ids, ids[part])
            floor = np.full(len(part), -2, np.float32)  # at least k vectors are as near as this
            rows, places = [], []
            for a in range(0, len(stored), 8192):
                score = x @ y[a : a + 8192].T
                width = score.shape[1]
                self_at = np.flatnonzero((own >= a) & (own < a + width))
                self_at = self_at[y_ids[own[self_at]] == ids[part][self_at]]
                score[self_at, own[self_at] - a] = -3
                groups = max(64, 4 * k)
                if width >= groups:  # the k-th of the groups' highest isn't above the k-th of all
                    high = score[:, : width // groups * groups].reshape(len(part), groups, -1).max(2)
                    floor = np.maximum(floor, np.partition(high, groups - k, axis=1)[:, groups - k])
                r, c = np.nonzero(score >= np.maximum(floor - np.float32(2e-5), np.float32(-2))[:, None])
                rows.append(r)
                places.append(c + a)
            r, c = np.concatenate(rows), np.concatenate(places)
            slices = [slice(i, i + 8192) for i in range(0, max(1, len(r)), 8192)]
            exact = np.concatenate([(ints[part[r[i]]].astype(np.int64) * ints[stored[c[i]]]).sum(1) for i in slices])
            cosine = exact / np.sqrt(square[part[r]] * square[stored[c]])
            order = np.lexsort((c, -cosine, r))
            r, c, cosine = r[order], c[order], cosine[order]
            top = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
            out.append((ids[part[r[top]]], y_ids[c[top]], cosine[top]))
    a, b, cosine = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"cid": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})


def _unit(ints: np.ndarray) -> np.ndarray:
    x = ints.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_near(classes: DataFrame, k: int = 10, block_bytes: int = 8 << 20, least_asked: int = 2048) -> DataFrame:
    """The k nearest other classes of each class, by comparing all of a kind: cid, other, cosine.

    Asked and stored vectors are cut into blocks of at most ``block_bytes``, and a pair of blocks is one task that returns only the best. Small
    kinds are asked in about eight blocks, to be spread. Work grows as the square of a kind's vectors, what is shuffled as their number times that of the blocks.
    """
    most = F.greatest(F.lit(1.0), F.lit(float(block_bytes)) / F.col("n"))
    asked_by = F.least(most, F.greatest(F.lit(float(least_asked)), F.col("size") / 8))
    kinds = classes.groupBy("kind_key", "n").agg(F.count("*").alias("size"))
    kinds = kinds.select("kind_key", "n", F.ceil(F.col("size") / most).cast("int").alias("nx"), F.ceil(F.col("size") / asked_by).cast("int").alias("nq"))
    rows = classes.join(F.broadcast(kinds), ["kind_key", "n"]).withColumn("x", F.pmod(F.xxhash64("cid"), F.col("nx")).cast("int")).withColumn("q", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("nq")).cast("int"))
    copies = F.expr("explode(concat(transform(sequence(0, nq - 1), i -> struct(x as xb, i as qb, 0 as side)), transform(sequence(0, nx - 1), i -> struct(i as xb, q as qb, 1 as side))))")
    blocks = rows.select("kind_key", "n", "cid", "vec", copies.alias("_c")).select("kind_key", "n", "cid", "vec", "_c.*")
    # kinds are few and large: rows are spread by their blocks, never by the kind alone
    blocks = blocks.repartition("kind_key", "n", "xb", "qb")
    found = blocks.groupBy("kind_key", "n", "xb", "qb").applyInArrow(lambda t: _best_of_block(t, k), "cid long, other long, cosine double")
    best = Window.partitionBy("cid").orderBy(F.col("cosine").desc(), "other")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def similar_classes(vectors: DataFrame, p: ProbeParams = ProbeParams(), least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, near): frag_id, cid of every vector, and per class its nearest other classes (cid, other, cosine), at most k.

    With ``least``, only those of at least that cosine, else of ``resembling``.
    """
    members, classes = vector_classes(vectors)
    return members, near_classes(classes, p, least)


def most_similar(vectors: DataFrame, p: ProbeParams = ProbeParams(), least: float | None = None) -> DataFrame:
    """The k most similar vectors of every vector, with ``least`` those of at least that cosine: frag_id, rank, other_id, cosine.

    ``vectors``: frag_id, kind, vec (see :func:`usable_vectors`). Only vectors of one kind are compared. Among equal
    cosines the smaller frag_id comes first; copies of a vector have cosine 1 to each other. Vectors that have no
    candidate have no rows, so do empty tables.
    """
    return _listed(*similar_classes(vectors, p, least), p.k)


def top_similar(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar vectors of every vector, whatever their cosine: frag_id, rank, other_id, cosine.

    As :func:`most_similar`, but exact: a list is shorter than k only where the kind has no more vectors.
    """
    members, classes = vector_classes(vectors)
    return _listed(members, exact_near(classes, k), k)


def _listed(members: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Lists of vectors from the lists of their classes."""
    by_id = Window.partitionBy("cid").orderBy("frag_id")
    # a class gives at most k + 1 of its members, the smallest, to any list
    few = members.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1).drop("_r")
    own = few.select("cid", F.lit(1.0).alias("cosine"), "frag_id")
    foreign = near.join(few.withColumnRenamed("cid", "other"), "other").select("cid", "cosine", "frag_id")
    # at most (k + 1) of the own class and k * (k + 1) others for each class
    lists = own.unionByName(foreign).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("frag_id").alias("id")))).alias("list"))
    lists = lists.where(F.size("list") > 1).select("cid", F.slice("list", 1, 2 * k + 1).alias("list"))
    found = members.join(lists, "cid").select("frag_id", F.posexplode(F.slice(F.filter("list", lambda x: x["id"] != F.col("frag_id")), 1, k)).alias("rank", "_x"))
    return found.select("frag_id", (F.col("rank") + 1).alias("rank"), F.col("_x.id").alias("other_id"), (-F.col("_x.d")).alias("cosine"))


def similar_pairs(vectors: DataFrame, least: float = 0.8, p: ProbeParams = ProbeParams()) -> DataFrame:
    """Pairs of which one is among the k most similar of the other, with at least the given cosine: frag_lo, frag_hi."""
    top = most_similar(vectors, p, least)
    return top.select(F.least("frag_id", "other_id").alias("frag_lo"), F.greatest("frag_id", "other_id").alias("frag_hi")).distinct()
