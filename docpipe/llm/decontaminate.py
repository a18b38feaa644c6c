"""Benchmark decontamination: rare word n-grams of the test items find candidate passages, Smith-Waterman scores them.

An item's seeds are its rarest distinct n-grams, `share` of them by the number of documents that hold each in the whole
corpus (ties by hash). Where at least `least` different seeds of an item (all, if it has fewer) lie close together in a
text, no two neighbours further apart than the item is long, the words around them are aligned with the item: match 2,
mismatch and gap -1, local. score = best alignment / (2 x words of the item), so 1 is an exact copy and 0.5 half an item
or a copy of which about a third was edited. Passages of at least `threshold` count, wherever in a text they are.

The benchmark is read in slices of at most SLICE_BYTES, each a pass over the corpus, so that what is sent to the executors
is bounded whatever its size; the corpus itself is never shuffled.

Defined results: null or blank texts and items match nothing. An item of fewer than n words has one seed, all its words. A
repeated row, of either table, gives its own rows; null identifiers stay null. Extra columns are ignored, or kept by
`clean`. The best of several passages of one item in a text is reported, of equals the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import batches as limit_batches

SLICE_BYTES = 8 << 20
SCHEMA = "doc_id bigint, item_id bigint, score double, start int, end int"


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the last words of it in item and words. Of equals that which ends first."""
    left = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best = (0, -1, -1)
    for i, w in enumerate(item):
        now = np.zeros_like(row)
        now[1:] = np.maximum(np.where(words == w, row[:-1] + 2, row[:-1] - 1), row[1:] - 1)
        now = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + left) - left, 0)
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i, j - 1)
        row = now
    return best


@dataclass(frozen=True)
class Items:
    """A slice of the benchmark: identifiers, words, and for the sorted seeds the items that own them."""

    ids: list
    words: list[np.ndarray]
    n: int
    seeds: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    need: np.ndarray

    def hits(self, offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place of the word in h, and number of each seed that occurs."""
        row, g = X.grams(offsets, h, self.n)
        length = np.diff(offsets)
        at = np.flatnonzero(mask(self.seeds)[(g & X.U64(MASK)).astype(np.int64)])
        k = np.searchsorted(self.seeds, g[at])
        k[k == len(self.seeds)] = 0
        true = self.seeds[k] == g[at]
        at, k = at[true], k[true]
        skipped = np.cumsum(np.minimum(length, self.n - 1)) - np.minimum(length, self.n - 1)  # words of earlier rows that start no gram
        return row[at], at + skipped[row[at]], k


MASK = (1 << 20) - 1
_masks: dict[int, np.ndarray] = {}


def mask(seeds: np.ndarray) -> np.ndarray:
    """Which low bits occur among the seeds: most words of a corpus are passed over by it."""
    key = hash(seeds.tobytes())
    if key not in _masks:
        _masks.clear()
        _masks[key] = np.zeros(MASK + 1, bool)
        _masks[key][(seeds & X.U64(MASK)).astype(np.int64)] = True
    return _masks[key]


def passages(items: Items, texts: pa.Array, least: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Row, item, score, first and last word of each passage that counts."""
    out = []
    for base, part in X.chunks(texts):
        offsets, h = X.words(part)
        row, at, k = items.hits(offsets, h)
        if not len(row):
            continue
        many = items.first[k + 1] - items.first[k]
        which = np.repeat(np.arange(len(k)), many)
        step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        item = items.owner[items.first[k[which]] + step]
        r, p, s = row[which], at[which], k[which]
        order = np.lexsort((p, item, r))
        r, p, s, item = r[order], p[order], s[order], item[order]
        size = np.array([len(w) for w in items.words])[item]
        cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (p[1:] - p[:-1] > size[1:])])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for a, b in zip(cut, np.r_[cut[1:], len(r)], strict=True):
            i = int(item[a])
            if b - a < items.need[i] or len(np.unique(s[a:b])) < min(least, items.need[i]):
                continue
            low, high = offsets[r[a]], offsets[r[a] + 1]
            m = len(items.words[i])
            lo, hi = max(low, p[a] - m), min(high, p[b - 1] + items.n + m)
            own = h[lo:hi]
            score, x, y = align(items.words[i], own)
            if score < threshold * 2 * m:
                continue
            _, _, back = align(items.words[i][x::-1] if x else items.words[i][:1], own[y::-1] if y else own[:1])
            key, new = (base + int(r[a]), i), (score / (2 * m), int(lo + y - back - low), int(lo + y - low))
            if key not in best or new[0] > best[key][0]:
                best[key] = new
        out += [(r_, i, *v) for (r_, i), v in best.items()]
    return out


def read(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    own = benchmark.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    n = 1 + int((own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SLICE_BYTES)
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        if rows:
            yield [r["i"] for r in rows], [r["t"] for r in rows]


def slices(docs: DataFrame, benchmark: DataFrame, n: int, share: float, least: int) -> Iterator[Items]:
    """The benchmark's items with their seeds; those of fewer than n words by themselves, their seeds being shorter."""
    for ids, texts in read(benchmark):
        offsets, h = X.words(pa.array(texts))
        words = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for size in range(1, n + 1):
            own = [k for k, w in enumerate(words) if min(len(w), n) == size]
            if own:
                yield seeded(docs, [ids[k] for k in own], [words[k] for k in own], size, share, least)


def seeded(docs: DataFrame, ids: list, words: list[np.ndarray], n: int, share: float, least: int) -> Items:
    """Items with their rarest n-grams, the documents that hold each n-gram being counted in the whole corpus."""
    own = [np.unique(X.grams(np.array([0, len(w)]), w, n)[1]) for w in words]
    grams = np.unique(np.concatenate(own))
    every = Items(ids, words, n, grams, np.arange(len(grams) + 1), np.zeros(len(grams), np.int64), np.ones(len(words), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(every.seeds), np.int64)
        for batch in batches:
            for _, part in X.chunks(batch.column(0)):
                row, _, k = every.hits(*X.words(part))
                pairs = np.unique(row * len(every.seeds) + k)
                total += np.bincount(pairs % len(every.seeds), minlength=len(every.seeds))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(X.lean(count), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(grams), np.int64)
    df[[r["k"] for r in found]] = [r["n"] for r in found]
    seeds: list[np.ndarray] = []
    for g in own:
        k = np.searchsorted(grams, g)
        seeds.append(k[np.lexsort((g, df[k]))][: max(1, int(np.ceil(share * len(g))))])
    used = np.unique(np.concatenate(seeds))
    k = np.searchsorted(used, np.concatenate(seeds))
    owner = np.repeat(np.arange(len(words)), [len(s) for s in seeds])
    order = np.argsort(k, kind="stable")
    first = np.searchsorted(k[order], np.arange(len(used) + 1))
    return Items(ids, words, n, grams[used], first, owner[order], np.array([min(least, len(s)) for s in seeds]))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 2, share: float = 0.5, least: int = 2, threshold: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, start, end (words of the text): one row for each text and item of which it holds a passage."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    limit_batches(docs.sparkSession)
    for k, items in enumerate(slices(docs, benchmark, n, share, least)):

        def matched(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = passages(items, batch.column(1), least, threshold)
                if found:
                    row, item, score, start, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                        ["doc_id", "item_id", "score", "start", "end"],
                    )

        found = own.mapInArrow(X.lean(matched), SCHEMA)
        out = found if k == 0 else out.unionByName(found)
    return out


def holds(items: Items, least: int, threshold: float):
    """Whether a text holds a passage of an item."""

    @F.arrow_udf(T.BooleanType())
    def flagged(column: pa.Array) -> pa.Array:
        hit = np.zeros(len(column), bool)
        hit[[r for r, *_ in passages(items, column, least, threshold)]] = True
        X.trimmed()
        return pa.array(hit)

    return flagged


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 2, share: float = 0.5, least: int = 2, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, that hold no passage of the benchmark."""
    out = docs
    limit_batches(docs.sparkSession)
    for items in slices(docs, benchmark, n, share, least):

        out = out.where(~holds(items, least, threshold)(docs["text"].cast("string")))
    return out
