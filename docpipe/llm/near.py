"""Near-duplicate groups by BagMinHash.

A text is a multiset of word n-grams (a shorter text is one gram). For each gram the weight axis is cut into dyadic blocks
(0,1], (1,2], (2,4], (4,8] ...; in each a Poisson process of its own, seeded by gram and block, throws points in order of
time over the block's width and over the m components of the signature. A gram of weight c owns the points of its blocks
up to c, those of the last block being thinned by where they fall; a component of the signature is the earliest point that
reaches it. So two texts agree in a component with the probability of their weighted Jaccard, min over max. Points are
drawn only up to the time at which all components of a text are filled.

Texts of equal multisets are one class, of which only the least doc_id goes on; the others are linked to it. So a text that
is copied into a third of all rows is one row in its buckets.

Signatures are cut into `bands` of `rows` components. Texts that share a band are candidates. First each candidate is
verified against one other, of the least doc_ids of its buckets that which shares most of them; verified pairs are joined to groups. Then, exactly, all pairs of one
bucket that are still in different groups, weren't compared and aren't too unlike in size are verified too, so nothing is
capped: a bucket of thousands of near copies costs as many comparisons as copies, not their square. A pair counts if the
exact overlap of the multisets (sum of minima over sum of maxima) is at least `threshold`.

Defined results: null and blank texts belong to no group. Rows of null doc_id take no part. Rows with the same doc_id are
one document of all their texts' signatures, and verified by the first of their texts in order. group_id is the least
doc_id of a group. Extra columns are ignored, or kept by `first_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .shared import batches as limit_batches
from .shared import small, written

U = np.uint64
CHUNK_BYTES = 1 << 20  # of texts that are signed at once


def bags(offsets: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and count of the distinct word n-grams of each text, in order of row and gram. A gram is 40 bits here."""
    row, g = X.grams(offsets, h, n)
    length = np.diff(offsets)
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.array([X.mix(np.bitwise_xor.reduce(X.mix(h[offsets[r] : offsets[r + 1]] + np.arange(length[r], dtype=U))) + U(length[r])) for r in short], U)
        row, g = np.concatenate([row, short]), np.concatenate([g, whole])
    key = np.sort((row.astype(U) << U(40)) | (g >> U(24)))
    if not len(key):
        return row, g, row
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[at] >> U(40)).astype(np.int64), key[at] & U((1 << 40) - 1), np.diff(np.r_[at, len(key)])


def signatures(row: np.ndarray, gram: np.ndarray, count: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """The m earliest points of each of n_rows texts, as int64, for the multisets of (row, gram, count); -1 for no grams."""
    total = np.bincount(row, count, n_rows)
    best = np.full(n_rows * m, np.inf)
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    own = np.minimum((count[which] - np.where(level == 0, 0.0, width)) / width, 1.0)  # share of the block that is owned
    with np.errstate(over="ignore"):
        seed = X.mix(gram[which] * U(0x9E3779B97F4A7C15) + X.mix(level.astype(U) + U(77)))
    rate, r = width * m, row[which]
    time = np.zeros(len(which))
    step = np.divide(1.0, total, out=np.zeros(n_rows), where=total > 0)
    limit = step * (np.log(m) + 1)
    live = np.arange(len(which))
    late: list[np.ndarray] = []
    number = np.zeros(len(which), U)
    while True:
        late = []
        while len(live):
            with np.errstate(over="ignore"):
                number[live] += U(1)
                a = X.mix(seed[live] + number[live] * U(0xD1B54A32D192ED03))
                t = time[live] - np.log(((a >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate[live]
                early = t <= limit[r[live]]
                if not early.all():
                    wait = live[~early]
                    number[wait] -= U(1)  # the same point is drawn again if the limit grows
                    late.append(wait)
                    live, a, t = live[early], a[early], t[early]
                time[live] = t
                b = X.mix(a ^ U(0xA0761D6478BD642F))
            inside = (b >> U(32)).astype(float) * 2.0**-32 < own[live]
            k = ((b & U(0xFFFFFFFF)) * U(m)) >> U(32)
            np.minimum.at(best, (r[live] * m + k.astype(np.int64))[inside], t[inside])
        open_rows = np.isinf(best.reshape(n_rows, m)).any(1) & (total > 0)
        if not open_rows.any():
            break
        limit = limit + np.where(open_rows, 3 * step, 0)
        live = np.concatenate(late) if late else live
        live = live[open_rows[r[live]]]
    best[np.isinf(best)] = -1
    return best.reshape(n_rows, m).view(np.int64)


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature."""
    s = sig.view(U).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(X.mix(np.arange(bands, dtype=U) + U(1)), (len(sig), bands)).copy()
        for k in range(rows):
            out = X.mix(out * U(0x9E3779B97F4A7C15) + s[:, :, k])
    return out


def occurrences(offsets: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and items of each text's multiset as a set: the k-th occurrence of a gram is an item of its own."""
    row, g, c = bags(offsets, h, n)
    which = np.repeat(np.arange(len(row)), c)
    k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
    with np.errstate(over="ignore"):
        items = X.mix(g[which] + (k.astype(U) << U(40)))
    return np.searchsorted(row[which], np.arange(len(offsets))), items


def connected(edges: DataFrame) -> DataFrame:
    """d, g: for each node of the edges (a, b) the least node that it is connected with. Large star and small star, alternating."""
    own = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    while True:
        both = own.union(own.select("u", "v"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = written(large.where("u < v").distinct(), "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        star = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        star = written(star.where("u < v").distinct(), "star")
        if not star.exceptAll(own).union(own.exceptAll(star)).head(1):
            break
        own = star
    return own.select(F.col("v").alias("d"), F.col("u").alias("g")).union(own.select(F.col("u").alias("d"), F.col("u").alias("g")).distinct())


def overlapping(docs: DataFrame, pairs: DataFrame, n: int, threshold: float, most: int = 2000) -> DataFrame:
    """Those of the pairs (a, b) whose multisets overlap by the threshold. docs: d, t. pairs: written.

    The texts of all b of an a meet in one place, at most about `most` of them with a copy of a's own.
    """
    salted = pairs.groupBy("a").agg(F.count("*").alias("c"))
    salted = pairs.join(salted, "a").select("a", "b", F.pmod(F.hash("b"), F.ceil(F.col("c") / most).cast("int")).alias("salt"))
    visits = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("d")).union(salted.select("a", "salt", F.lit(0), "a").distinct())
    visits = written(visits.groupBy("d").agg(F.collect_list(F.struct("a", "salt", "role")).alias("v"), F.count("*").alias("c")), "visits")
    bulk = visits.agg(F.sum(24 + 16 * F.col("c"))).first()[0] or 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, center, last = None, np.empty(0, U), None
        for batch in batches:
            a, salt, role, d = (np.asarray(batch.column(k)) for k in range(4))
            kept: list[tuple[int, int]] = []
            for base, part in X.chunks(batch.column(4)):
                at, items = occurrences(*X.words(part), n)
                for j in range(len(part)):
                    i, own = base + j, items[at[j] : at[j + 1]]
                    if (a[i], salt[i]) != group:
                        group, center, last = (a[i], salt[i]), own, (0, a[i])
                    elif (role[i], d[i]) != last:  # else another text of the same document
                        last = (role[i], d[i])
                        both = len(np.intersect1d(center, own, assume_unique=True))
                        if both and both >= threshold * (len(center) + len(own) - both):
                            kept.append((a[i], d[i]))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.int64())], ["a", "b"])

    rows = docs.join(small(visits.select("d", "v"), bulk, 1), "d").select("d", "t", F.explode("v").alias("v")).select("v.a", "v.salt", "v.role", "d", "t")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "d", "t").mapInArrow(X.lean(compare), "a bigint, b bigint")


def groups(docs: DataFrame, n: int = 3, bands: int = 48, rows: int = 4, threshold: float = 0.4) -> DataFrame:
    """doc_id, group_id: the documents that have a near duplicate."""
    limit_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string").alias("t")).where("d is not null and t is not null")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, part in X.chunks(batch.column(1), CHUNK_BYTES):
                offsets, h = X.words(part)
                row, gram, count = bags(offsets, h, n)
                if not len(row):
                    continue
                at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                kept, size = row[at], np.add.reduceat(count, at)
                with np.errstate(over="ignore"):
                    whole = X.mix(np.add.reduceat(X.mix(gram * U(0x9E3779B97F4A7C15) + count.astype(U)), at) + size.astype(U))
                sig = banded(signatures(np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(row)])), gram, count, len(kept), bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(base + kept)).cast(pa.int64()), pa.array(whole.view(np.int64)), pa.array(size.astype(np.int64)), X.lists(np.arange(len(kept) + 1) * bands, sig.ravel())], ["d", "x", "n", "s"])

    signs = written(own.mapInArrow(X.lean(signed), "d bigint, x bigint, n bigint, s array<bigint>"), "signatures")
    least = written(signs.groupBy("x").agg(F.min("d").alias("r")), "classes")
    copies = written(signs.select("d", "x").join(least, "x").where("d <> r").select(F.col("r").alias("a"), F.col("d").alias("b")).distinct(), "copies")
    keys = signs.join(least.withColumnRenamed("r", "d"), ["x", "d"], "left_semi").select("d", "n", F.explode("s").alias("k"))
    ends = written(keys.groupBy("k").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("k", "a"), "ends")
    buckets = written(keys.join(small(ends, 16), "k").groupBy("k", "d").agg(F.max("n").alias("n"), F.first("a").alias("a")), "buckets")
    # Of the documents that are least of a text's buckets the one that shares most buckets with it, hence most alike.
    shared = buckets.where("d <> a").groupBy("d", "a").agg(F.count("*").alias("c"))
    first = written(shared.groupBy("d").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", F.col("d").alias("b")), "first")
    edges = written(overlapping(own, first, n, threshold), "overlaps").union(copies)
    found = written(connected(edges), "groups")
    put = written(buckets.join(found, "d", "left").select("k", "d", "n", "a", F.coalesce("g", "d").alias("g")), "put")
    mixed = put.groupBy("k").agg(F.min("g").alias("p"), F.max("g").alias("q")).where("p < q").select("k")
    put = written(put.join(mixed, "k", "left_semi"), "mixed")
    # All pairs of a bucket that are in different groups: a member outside the group of the least one, with any other.
    base = put.where("d = a").select("k", F.col("g").alias("h"))
    rest = put.join(base, "k").where("g <> h").select("k", F.col("d").alias("e"), F.col("g").alias("f"), F.col("n").alias("m"))
    second = rest.join(put, "k").where(f"f <> g and least(m, n) >= {threshold} * greatest(m, n)").select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b")).distinct()
    second = written(second.join(first, ["a", "b"], "left_anti"), "second")
    if second.head(1):
        more = written(overlapping(own, second, n, threshold), "more")
        if more.head(1):
            found = written(connected(edges.union(more)), "groups")
    return found.select(F.col("d").alias("doc_id"), F.col("g").alias("group_id"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, with their columns, without all documents of a group but that of the least doc_id; of repeated rows all stay."""
    out = written(groups(docs, **options).where("doc_id <> group_id").select(F.col("doc_id").alias("__later")), "later")
    return docs.join(small(out, 8), docs["doc_id"].cast("bigint") == F.col("__later"), "left_anti")
