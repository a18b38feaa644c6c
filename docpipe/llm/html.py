"""Main text of HTML pages by host suffix arrays.

Markup becomes text: head, scripts, styles, templates and comments go, block tags end a line, entities are resolved. The
words of all pages of a host are one token stream, with a mark of its own after each page so that nothing repeats across a
page's end. Its suffix array, by prefix doubling to the depth `least`, puts equal runs of that many words together; where
such a class has suffixes from distinct pages, the words are covered. Covered words are boilerplate and go, in all pages;
what is left between them are the unique runs, one a line. A longer repeated substring is covered by its overlapping runs.

The stream of a host is sorted in one task as long as it has at most `most` words. Beyond that the suffixes of the host are
sorted by the cluster: its suffix array to that depth is sharded by the hash of a suffix's first `least` words, and a shard
sorts the hashes that batches of pages send, each once. Both give the same result, but for a chance of 2**-56 for two runs.

Defined results: a null html gives null text, one without words ''; neither covers anything. Pages of a null url, or one
without a host, are of the host ''. Rows of the same page_id are one page when repeats across pages are sought, so a
repeated row covers nothing, and each gives a row. A page of null page_id is a page of its own, known by url and html.
Extra columns are ignored. Words are compared as they are, split at white space.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import BROADCAST_BYTES, small, written
from .text import unvarints, varints

U = np.uint64
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
DROPPED = r"(?is)<(head|script|style|noscript|template|svg)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|section|header|footer|nav|main|aside|blockquote|pre|hr|form|body|html|dl|dt|dd|figure|title)\b[^>]*>"


def visible(html: Column) -> Column:
    """The text of a page, blocks on lines of their own; entities are still written out."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, " "), BLOCK, "\n"), r"<[a-zA-Z/!?][^>]*>", "")


@F.pandas_udf(T.StringType())
def resolved(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: entities.unescape(t) if t is not None and "&" in t else t)


def runs(parts: list[str], covered: np.ndarray) -> str:
    """What isn't covered, a run on each line."""
    left = np.flatnonzero(~covered)
    if not len(left):
        return ""
    cut = np.flatnonzero(np.diff(left) > 1) + 1
    return "\n".join(" ".join(parts[i] for i in run) for run in np.split(left, cut))


def suffix_classes(words: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the class of each suffix by its first `depth` words, in the order of a suffix array to that depth. words: codes."""
    rank, known = words.astype(np.int32) + 1, 1
    while known < depth:
        step = min(known, depth - known)
        key = rank.astype(np.int64) << 32
        key[:-step] |= rank[step:]
        order = np.argsort(key)
        key = key[order]
        new = np.cumsum(np.r_[True, key[1:] != key[:-1]], dtype=np.int32)
        del key
        rank[order] = new
        known += step
    return rank


def covered(words: np.ndarray, page: np.ndarray, stretch: np.ndarray, depth: int) -> np.ndarray:
    """Which words of a stream lie in a run of depth words that occurs in distinct pages. words: codes; stretch: the row of each word; page: its page, that several rows may have."""
    if len(words) < depth:
        return np.zeros(len(words), bool)
    fence = np.flatnonzero(np.r_[stretch[1:] != stretch[:-1], True]) + 1  # a mark after each row
    stream = np.insert(words, fence, int(words.max()) + 1 + np.arange(len(fence), dtype=np.int32))
    owner = np.insert(page, fence, -1)
    rank = suffix_classes(stream, depth)
    low = np.full(rank.max() + 1, np.iinfo(np.int32).max, np.int32)
    high = np.full(rank.max() + 1, -1, np.int32)
    np.minimum.at(low, rank, owner)
    np.maximum.at(high, rank, owner)
    at = np.flatnonzero((low[rank] < high[rank]) & (low[rank] >= 0))  # a run across a mark is in a class by itself
    edge = np.zeros(len(stream) + depth + 1, np.int8)
    edge[at] += 1
    edge[at + depth] -= 1
    return (np.cumsum(edge[: len(stream)], dtype=np.int32) > 0)[owner >= 0]


SCHEMA = "page_id bigint, url string, host string, text string, words int, removed int"


def rebuilt(pages: pa.RecordBatch, offsets: np.ndarray, parts: pa.Array, gone: np.ndarray) -> pa.RecordBatch:
    """Output rows. pages: page_id, url, host, text."""
    texts, removed = [], []
    for k, null in enumerate(np.asarray(pages.column(3).is_null())):
        a, b = offsets[k], offsets[k + 1]
        texts.append(None if null else runs(parts.slice(a, b - a).to_pylist(), gone[a:b]))
        removed.append(int(gone[a:b].sum()))
    return pa.RecordBatch.from_arrays(
        [*(pages.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array(np.diff(offsets).astype(np.int32)), pa.array(removed, pa.int32())], ["page_id", "url", "host", "text", "words", "removed"]
    )


def in_one_task(pages: DataFrame, least: int) -> DataFrame:
    """Rows of hosts that each fit in a task: page_id, url, host, text, page."""

    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        offsets, parts = X.split(X.filled(table.column(3)))
        keep = np.asarray(pc.binary_length(parts)) > 0
        if not keep.all():
            parts = parts.filter(pa.array(keep))
            offsets = np.r_[0, np.cumsum(keep)][offsets]
        _, page = np.unique(np.asarray(table.column(4)), return_inverse=True)
        page = np.repeat(page.astype(np.int32), np.diff(offsets))
        # Stretches of one page that follow each other still need a mark between them.
        stretch = X.owners(offsets).astype(np.int32)
        gone = covered(np.asarray(parts.dictionary_encode().indices), page, stretch, least)
        batch = table.to_batches()[0]
        return pa.Table.from_batches([rebuilt(batch, offsets, parts, gone)])

    return pages.groupBy("host").applyInArrow(sort, SCHEMA)


def windows(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Offsets and words of pages (page_id, url, host, text, ...); row and 56-bit hash, with the host, of each run of `least` words."""
    offsets, parts = X.split(X.filled(batch.column(3)))
    keep = np.asarray(pc.binary_length(parts)) > 0
    parts = parts.filter(pa.array(keep))
    offsets = np.r_[0, np.cumsum(keep)][offsets]
    row, g = X.grams(offsets, X.hashes(parts, False)[0], least)
    with np.errstate(over="ignore"):
        g = X.mix(g + X.string_hashes(X.filled(batch.column(2)))[row])
    return offsets, parts, row, g >> U(8)


def by_cluster(pages: DataFrame, least: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The same for hosts of any size, the suffixes' classes being found by the cluster.

    A batch of pages sends its distinct runs once, as sorted and packed 56-bit hashes, with whether several of its pages have
    them; a run that two batches have, or several pages of one, repeats. Pages of which there are several rows send theirs
    with the page, so that a page doesn't meet itself. The runs that repeat come back to all pages if they take at most
    most_bytes, else by a join to the rows that have them.
    """
    counts = pages.groupBy("host", "page").count().where("count > 1").select("host", "page", F.lit(True).alias("twice"))
    counts = written(counts, "twice")
    keyed = pages.join(small(counts, 40), ["host", "page"], "left").select("page_id", "url", "host", "text", "page", F.coalesce("twice", F.lit(False)).alias("twice"))
    n = max(64, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, row, g = windows(batch, least)
            page, twice = np.asarray(batch.column(4)), np.asarray(batch.column(5))[row]
            own = np.unique(g[twice])
            pairs = np.unique(np.stack([g[twice].view(np.int64), page[row[twice]]], 1), axis=0) if len(own) else np.empty((0, 2), np.int64)
            order = np.argsort(g[~twice], kind="stable")
            h, r = g[~twice][order], row[~twice][order]
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
            start = np.flatnonzero(new)
            several = np.maximum.reduceat(r, start) > np.minimum.reduceat(r, start) if len(start) else np.empty(0, bool)
            h = h[start]
            bucket = (h >> U(40)) % U(n) if len(h) else h
            order = np.argsort(bucket, kind="stable")
            h, several, bucket = h[order], several[order], bucket[order].astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(n + 1))
            where = ((pairs[:, 0].view(U) if len(pairs) else pairs[:, 0].astype(U)) >> U(40)) % U(n)
            rows = []
            for k in range(n):
                a, b = cut[k], cut[k + 1]
                mine = pairs[where == U(k)] if len(pairs) else pairs
                if b > a or len(mine):
                    rows.append((k, steps(h[a:b]), np.packbits(several[a:b]).tobytes(), mine.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["k", "h", "several", "pairs"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of a bucket's runs that distinct pages have. A hash is in one bucket, a bucket in one partition."""
        hashes, hit, pairs = [], [], []
        for batch in batches:
            for h, several, mine in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own = unsteps(h)
                hashes.append(own)
                hit.append(own[np.unpackbits(np.frombuffer(several, np.uint8))[: len(own)].astype(bool)])
                pairs.append(np.frombuffer(mine, np.int64).reshape(-1, 2))
        if not hashes:
            return
        distinct = np.unique(np.concatenate(pairs), axis=0)[:, 0].view(U).copy() if sum(map(len, pairs)) else np.empty(0, U)
        every = np.sort(np.concatenate([*hashes, distinct]))
        out = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *hit]))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["g"])

    shards = keyed.mapInArrow(X.lean(packed), "k int, h binary, several binary, pairs binary").repartition(n, "k")
    again = written(shards.mapInArrow(X.lean(repeated), "g bigint"), "repeated")

    def without(batch: pa.RecordBatch, has) -> pa.RecordBatch:
        offsets, parts, row, g = windows(batch, least)
        length = np.minimum(np.diff(offsets), least - 1)
        at = np.flatnonzero(has(row, g))
        start = at + (np.cumsum(length) - length)[row[at]]
        edge = np.zeros(len(parts) + 1, np.int32)
        edge[start] += 1
        np.subtract.at(edge, start + least, 1)
        return rebuilt(batch, offsets, parts, np.cumsum(edge[:-1]) > 0)

    if 8 * again.count() <= most_bytes:
        known = np.sort(again.toArrow().column(0).to_numpy().view(U))

        def cut_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def has(row: np.ndarray, g: np.ndarray) -> np.ndarray:
                if not len(known):
                    return np.zeros(len(g), bool)
                return known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g

            for batch in batches:
                yield without(batch, has)

        return keyed.mapInArrow(X.lean(cut_known), SCHEMA)
    rows = written(keyed.withColumn("row", F.monotonically_increasing_id()), "large-hosts")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, row, g = windows(batch, least)
            yield pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(row)), pa.array(g.view(np.int64))], ["row", "g"])

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(6)
            own = np.repeat(np.arange(len(batch)), np.asarray(pc.fill_null(pc.list_value_length(sets), 0)))
            with np.errstate(over="ignore"):
                keys = X.mix(np.asarray(sets.flatten()).view(U) + X.mix(own.astype(U)))
                yield without(batch, lambda row, g, keys=keys: np.isin(X.mix(g + X.mix(row.astype(U))), keys))

    hit = rows.mapInArrow(X.lean(listed), "row bigint, g bigint").join(again, "g", "left_semi").groupBy("row").agg(F.collect_set("g").alias("gs"))
    return rows.join(hit, "row", "left").select("page_id", "url", "host", "text", "page", "twice", "gs").mapInArrow(X.lean(cut_joined), SCHEMA)


def steps(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, in varints."""
    h = np.sort(h)
    return varints(np.array([0, len(h)]), np.diff(h.astype(np.int64), prepend=0))[1] if len(h) else b""


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unvarints(data)).astype(U)


def extract(pages: DataFrame, least: int = 8, most: int = 4_000_000, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, host, text, words, removed: one row for each row of pages; words: before removal."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    # A word and the space after it are two bytes at least; the bytes of html bound the words of a host.
    size = own.groupBy("host").agg(F.sum(F.octet_length("html")).alias("n"))
    large = [r["host"] for r in size.where(F.col("n") > 8 * most).select("host").collect()]
    texts = own.select("page_id", "url", "host", resolved(visible(F.col("html"))).alias("text"))
    page = F.when(F.col("page_id").isNotNull(), F.xxhash64(F.lit(0), "page_id")).otherwise(F.xxhash64(F.lit(1), "url", "text"))
    texts = texts.withColumn("page", page)
    if not large:
        return in_one_task(texts, least)
    return in_one_task(texts.where(~F.col("host").isin(large)), least).unionByName(by_cluster(texts.where(F.col("host").isin(large)), least, most_bytes))
