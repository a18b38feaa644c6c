"""Approximate maximum inner product search by score-aware quantisation.

Vectors are put into leaves by k-means. What is left of a vector after its leaf's centre is quantised in
subspaces of two dimensions with 16 centres each, four bits. The loss is anisotropic: an error e of a vector x counts
|e|^2 + (eta - 1) (e . x / |x|)^2, eta = (d - 1) t^2 / (1 - t^2), since an error along x changes the large products most.
Codes are chosen by coordinate descent on that loss, centres by its least squares given the other subspaces' errors, in
turn. Both are fitted on a sample of about `sample` vectors, by hash; every vector is then in the index. A leaf of more
than `most` vectors, as of equal ones, is searched in parts.

Queries are the vectors whose id is divisible by `every`. A query goes to the leaves whose centres have the largest product with it; to how many follows from
the data: so many as hold `target` of the exact neighbours of `tried` vectors, which are searched for among all. There the tables
of its products with all centres are summed along the codes, two codes a byte; the `rerank` best are ranked again by exact
products, and so are all whose sums equal the last one's, or come as near to the k-th exact product as the largest error of
the sums of those already ranked. So the number doesn't split groups of equal vectors, nor, as far as that error holds, of
nearly equal ones. The `k` best of all leaves are the result.

Defined results: vectors that are null, empty, of another length than most, or hold a null, NaN or infinity, and rows of
null vec_id, are left out on both sides. Repeated rows of an id are one if the vectors are equal; else each is a query, and
a vector isn't its own id's neighbour. Equal products are ordered by neighbour's id. With k or fewer vectors all others are
returned. Zero vectors are vectors like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .shared import written

SCHEMA = "vec_id bigint, neighbor_id bigint, score double"
CENTRES = 16
U = np.uint64


@dataclass(frozen=True)
class Index:
    """Centres of the leaves, and of each subspace; eta of the loss."""

    leaves: np.ndarray
    books: np.ndarray
    eta: float


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(len(column), d)


def padded(x: np.ndarray) -> np.ndarray:
    """With an even number of dimensions."""
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def nearest(x: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The leaf of each vector, by distance."""
    return np.argmax(x @ leaves.T - 0.5 * (leaves * leaves).sum(1), 1)


def codes(x: np.ndarray, r: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes of residuals r of vectors x, by coordinate descent from the nearest centres."""
    n, m = len(x), len(books)
    u = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, m, -1)
    r = r.reshape(n, m, -1)
    out = np.argmin(-2 * np.einsum("nmd,mjd->nmj", r, books) + (books * books).sum(2), 2)
    along = np.take_along_axis(np.einsum("nmd,nmd->nm", r, u)[:, :, None] - np.einsum("nmd,mjd->nmj", u, books), out[:, :, None], 2)[:, :, 0]
    total = along.sum(1)
    for _ in range(sweeps):
        for s in range(m):
            e = r[:, s, None, :] - books[s]
            p = (e * u[:, s, None, :]).sum(2)
            rest = total - along[:, s]
            best = np.argmin((e * e).sum(2) + (eta - 1) * (rest[:, None] + p) ** 2, 1)
            out[:, s], along[:, s] = best, p[np.arange(n), best]
            total = rest + along[:, s]
    return out


def summed(rows: DataFrame, part, width: int) -> dict[int, np.ndarray]:
    """Sums over all rows of what part(x) gives for a batch of vectors: a matrix of `width` columns, by row of it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                new = part(np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32))
                total = new if total is None else total + new
        if total is not None:
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at].astype(float)), pa.list_(pa.float64()))], ["k", "v"])

    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return {r[0]: np.array(r[1:]) for r in rows.select("x").mapInArrow(X.lean(add), "k int, v array<double>").groupBy("k").agg(*sums).collect()}


def fit(rows: DataFrame, k: int, d: int, threshold: float = 0.2, rounds: int = 5) -> Index:
    """An index of k leaves, fitted on rows (i, x)."""
    seeds = rows.orderBy(F.xxhash64("i"), "i", "x").limit(max(k, CENTRES)).collect()
    seeds = np.array([r["x"] for r in seeds], np.float32)
    leaves = seeds[:k].copy()
    for _ in range(rounds):

        def near(x: np.ndarray, leaves: np.ndarray = leaves) -> np.ndarray:
            at = nearest(x, leaves)
            out = np.zeros((len(leaves), d + 1))
            np.add.at(out, at, np.c_[x, np.ones(len(x))])
            return out

        found = summed(rows, near, d + 1)
        for i, v in found.items():
            leaves[i] = v[:-1] / v[-1]
    even = padded(leaves)
    m = even.shape[1] // 2
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    first = padded(seeds)[:CENTRES] - even[nearest(seeds[:CENTRES], leaves)]
    books = np.zeros((m, CENTRES, 2), np.float32)
    books[:, : len(first)] = first.reshape(len(first), m, 2).transpose(1, 0, 2)
    books[:, :, 0] += np.linspace(-1e-4, 1e-4, CENTRES)  # centres that are equal part
    for _ in range(rounds):

        def squares(x: np.ndarray, books: np.ndarray = books) -> np.ndarray:
            y = padded(x)
            r = y - even[nearest(x, leaves)]
            c = codes(y, r, books, eta)
            u = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).reshape(len(y), m, 2)
            r = r.reshape(len(y), m, 2)
            along = ((r - books[np.arange(m), c]) * u).sum(2)
            rest = along.sum(1, keepdims=True) - along + (r * u).sum(2)
            out = np.zeros((m * CENTRES, 6))
            a = np.stack([np.ones_like(along), u[:, :, 0] ** 2, u[:, :, 0] * u[:, :, 1], u[:, :, 1] ** 2], 2)
            b = r + (eta - 1) * u * rest[:, :, None]
            np.add.at(out, c + np.arange(m) * CENTRES, np.concatenate([a, b], 2))
            return out

        books = books.copy()
        for i, (count, xx, xy, yy, bx, by) in summed(rows, squares, 6).items():
            a = np.array([[count + (eta - 1) * xx, (eta - 1) * xy], [(eta - 1) * xy, count + (eta - 1) * yy]])
            books[i // CENTRES, i % CENTRES] = np.linalg.solve(a, [bx, by])
    return Index(leaves, books, eta)


def scanned(index: Index, packed: np.ndarray, queries: np.ndarray, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places of its best candidates in a leaf, by table sums over packed codes; and all sums, negative."""
    m = len(index.books)
    tables = np.einsum("qmd,mjd->qmj", padded(queries).reshape(len(queries), m, 2), index.books)
    if m % 2:
        tables = np.concatenate([tables, np.zeros((len(queries), 1, CENTRES), np.float32)], 1)
    pairs = np.ascontiguousarray((tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES).transpose(1, 2, 0))
    sums = np.zeros((len(packed), len(queries)), np.float32)
    for s in range(len(pairs)):
        sums += pairs[s].take(packed[:, s], 0)
    r = min(rerank, len(packed))
    less = np.ascontiguousarray(-sums.T)
    best = np.argpartition(less, r - 1, 1)[:, :r]
    return best, less


def packed(c: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    c = np.pad(c, ((0, 0), (0, c.shape[1] % 2))).astype(np.uint8)
    return c[:, 0::2] << 4 | c[:, 1::2]


def probes(rows: DataFrame, index: Index, k: int, target: float, tried: int) -> int:
    """How many leaves a query needs, by the exact neighbours of the `tried` vectors with the least hashes among all vectors."""
    some = rows.orderBy(F.xxhash64("i"), "i", "x").limit(tried).collect()
    ids, q = np.array([r["i"] for r in some]), np.array([r["x"] for r in some], np.float32)
    d = q.shape[1]
    place = np.argsort(np.argsort(-(q @ index.leaves.T), 1, kind="stable"), 1)  # of each leaf, for each query

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1), d)
            scores = q @ x.T
            scores[ids[:, None] == np.asarray(batch.column(0))[None, :]] = -np.inf
            r = min(k, len(x))
            top = np.argpartition(-scores, r - 1, 1)[:, :r]
            need = place[np.arange(len(q))[:, None], nearest(x, index.leaves)[top]]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), r)), pa.array(np.take_along_axis(scores, top, 1).ravel().astype(float)), pa.array(need.ravel().astype(np.int32))], ["q", "s", "p"])

    found = rows.mapInArrow(X.lean(best), "q bigint, s double, p int").where("s > double('-inf')")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "p"))
    counts = found.select("p", rank.alias("r")).where(F.col("r") <= k).groupBy("p").count().orderBy("p").collect()
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= target * total:
            return r["p"] + 1
    return 1


def neighbours(vectors: DataFrame, k: int = 10, target: float = 0.97, tried: int = 256, rerank: int = 128, every: int = 1, sample: int = 1 << 17, most: int = 1 << 18) -> DataFrame:
    """vec_id, neighbor_id, score, rank: for each vector of an id divisible by `every` the k others of the largest inner product."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("bigint").alias("i"), F.col("embedding").cast("array<float>").alias("x")).where(
        "i is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < float('inf'))"
    )
    kinds = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if kinds is None:
        return spark.createDataFrame([], SCHEMA + ", rank int")
    d = kinds["d"]
    rows = written(own.where(F.size("x") == d).distinct(), "vectors")
    n = rows.count()
    share = -(-n // sample)
    index = fit(written(rows.where(F.pmod(F.xxhash64("i", "x"), F.lit(share)) == 0), "sample") if share > 1 else rows, max(1, round(n**0.5 / 4)), d)
    p = probes(rows, index, k, target, tried)
    even = padded(index.leaves)

    def filled(x: np.ndarray) -> np.ndarray:
        return np.bincount(nearest(x, index.leaves), minlength=len(index.leaves))[:, None].astype(float)

    parts = np.ones(len(index.leaves), np.int64)
    for leaf, v in summed(rows, filled, 1).items():
        parts[leaf] = -(-int(v[0]) // most)
    base = np.cumsum(parts) - parts  # of a leaf's parts, the first one's number

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its leaf, coded, and as a query in its leaves."""
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1), d)
            at = nearest(x, index.leaves)
            c = packed(codes(padded(x), padded(x) - even[at], index.books, index.eta))
            ids = np.asarray(batch.column(0))
            own = base[at] + (X.mix(ids.view(U)) % parts[at].astype(U)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.zeros(len(x), np.int32)), batch.column(0), batch.column(1), pa.array([v.tobytes() for v in c], pa.binary())], ["leaf", "role", "i", "x", "c"])
            asked = np.flatnonzero(ids % every == 0)
            to = np.argpartition(-(x[asked] @ index.leaves.T), p - 1, 1)[:, :p]
            for s in range(p):
                leaf = to[:, s]
                which = np.repeat(np.arange(len(asked)), parts[leaf])
                own = np.repeat(base[leaf], parts[leaf]) + np.arange(len(which)) - np.repeat(np.cumsum(parts[leaf]) - parts[leaf], parts[leaf])
                take = pa.array(asked[which])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.ones(len(which), np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.nulls(len(which), pa.binary())], ["leaf", "role", "i", "x", "c"])

    center = np.repeat(np.arange(len(parts)), parts)  # the leaf of each part

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by leaf, its vectors before its queries."""
        now, held, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            leaf, role = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (role[1:] != role[:-1])])
            for a, b in zip(cut, np.r_[cut[1:], len(leaf)], strict=True):
                part = batch.slice(a, b - a)
                if leaf[a] != now:
                    now, held, ready = leaf[a], [], None
                if role[a] == 0:
                    held.append(part)
                    continue
                if ready is None and held:
                    ready = (
                        np.concatenate([np.asarray(y.column(2)) for y in held]),
                        np.concatenate([matrix(y.column(3), d) for y in held]),
                        np.concatenate([np.frombuffer(b"".join(y.column(4).to_pylist()), np.uint8).reshape(len(y), -1) for y in held]),
                    )
                if ready is None:
                    continue
                ids, x, c = ready
                step = max(1, (1 << 20) // len(ids))
                for lo in range(0, len(part), step):
                    q = part.slice(lo, step)
                    who, y = np.asarray(q.column(2)), matrix(q.column(3), d)
                    at, less = scanned(index, c, y, rerank + 1)
                    exact = np.einsum("qd,qrd->qr", y.astype(float), x[at].astype(float))
                    shift = y.astype(float) @ index.leaves[center[now]].astype(float)
                    sums = np.take_along_axis(less, at, 1)
                    error = np.abs(exact - shift[:, None] + sums).max(1)
                    exact[ids[at] == who[:, None]] = -np.inf
                    order = np.lexsort((ids[at], -exact), axis=1)[:, :k]
                    exact, best = np.take_along_axis(exact, order, 1), np.take_along_axis(ids[at], order, 1)
                    least = exact[:, k - 1] - shift - error if exact.shape[1] == k else np.full(len(y), -np.inf)
                    near = less <= np.maximum(sums.max(1), -least)[:, None]
                    for j in np.flatnonzero(near.sum(1) > at.shape[1]):
                        places = np.flatnonzero(near[j])
                        whole = np.einsum("qd,qrd->qr", y[j : j + 1].astype(float), x[places][None].astype(float))[0]
                        whole[ids[places] == who[j]] = -np.inf
                        order = np.lexsort((ids[places], -whole))[:k]
                        exact[j], best[j] = whole[order], ids[places][order]
                    real = exact > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, real.sum(1))), pa.array(best[real]), pa.array(exact[real])], ["vec_id", "neighbor_id", "score"])

    found = rows.mapInArrow(X.lean(placed), "leaf int, role int, i bigint, x array<float>, c binary").repartition("leaf").sortWithinPartitions("leaf", "role").mapInArrow(X.lean(searched), SCHEMA)
    found = found.groupBy("vec_id", "neighbor_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id"))
    return found.select("*", rank.alias("rank")).where(F.col("rank") <= k)
