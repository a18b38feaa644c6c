"""Line deduplication by an exact set-similarity join.

A line (between line feeds) is the set of its words. A line goes if an earlier line, in any document, has a Jaccard
similarity of at least `threshold` with it; earlier means less in (doc_id, line number), whether or not that line goes too.

Words are ordered by rarity: their occurrences in the whole corpus, counted in 2**20 buckets of word hashes, then hash.
Any total order gives exact results, so that the counts needn't be exact for a word; they only have to tell the common
ones. A line of n words is indexed by its first n - ceil(threshold n) + 1. Lines that share such a word are compared by
length (each with those that aren't shorter, nor longer than n / threshold), by the places of the word in both, and by a
sketch of each set: each word turns over one bit of 64, or up to 512 for larger sets, so the bits that two sketches differ
in are no more than the words that the sets differ in. None of these filters loses a pair. What is left is verified with the full sets.

Words that occur more than `hot` times don't make a group of their own. Lines that share such a word, as the first that
they share, also share a second one among the first n - ceil(threshold n) + 2; short lines meet by these two words, long
ones by the word and their class of length. A group therefore doesn't grow with the commonest words. Equal sets are put
together before anything is shuffled, as far as they are read by one task.

One partner is enough for a line to go. So each line is first verified with the possible partner that is nearest by sketch;
if that fails, with all others that are known. Only the first `partners` of a line in a group are noted at first; lines that
had more, and didn't go, are compared with all lines in a last round: by one more pass over the texts that are sent these
lines' sets, if these take at most `broadcast` bytes, else by shuffling the prefixes again. Lines of equal sets need no
verification. Thousands of variants of a line cost about as many verifications as variants.

Shuffled are packed columns, one row for each bucket of prefix words and about ROWS of them.

Defined results: lines without words are kept. Rows of null doc_id, and null texts, are left as they are and take no part.
Rows of the same doc_id are told apart by their lines; equal rows are one document, and get the same lines removed. A text
of which every line with words goes is '' (or line feeds). Extra columns are kept. Words are told apart by 40 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .shared import BROADCAST_BYTES, small, written
from .shared import batches as limit_batches

U = np.uint64
HALF = U(20)  # bits of a word: 20 of its bucket, 20 more
BUCKETS = 1 << 20
MASK = U(BUCKETS - 1)
SLICES = 64  # in which the counts are summed
LEVELS = np.array([40, 100, 250])  # sets of more words have 128, 256, 512 bits
SHORT = 64  # lines of more words meet by hot words and class of length
BLOCK = 1 << 18  # pairs that are looked at at once
PARTNERS = 64  # of a line in a group that are noted before the last round
ROWS = 1 << 19  # prefix words that are packed at once
HOT = 1 << 15
PART_BYTES = 12 << 20  # of prefix words in a partition, about
ROW_BYTES = 36
LINES = 1 << 22  # in one batch of sets
KEY = ["d", "l", "s"]
PARTNER = ["ad", "al", "as"]


def parted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row, number and text of the lines of a column of texts, a bounded part at a time if no single text is larger."""
    for base, part in X.chunks(column):
        offsets, lines = X.split(part, "\n")
        row = X.owners(offsets)
        number = np.arange(len(row)) - offsets[row]
        for a in range(0, len(row), LINES):
            yield base + row[a : a + LINES], number[a : a + LINES], lines.slice(a, LINES)


def line_sets(lines: pa.Array, place: np.ndarray | None = None, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line and word of the distinct words of lines, in order of line and word; their mixed hashes; and the hash of each line's set. place: of buckets by rarity, to have words in that order; back: the bucket of each place."""
    at, h = X.words(lines)
    h >>= U(24)
    if place is not None:
        h = (place[h & MASK].astype(U) << HALF) | (h >> HALF)
    h |= X.owners(at).astype(U) << U(40)
    h.sort()
    if len(h):
        h = h[np.r_[True, h[1:] != h[:-1]]]
    line = (h >> U(40)).astype(np.int64)
    word = h & U((1 << 40) - 1)
    mixed = X.mix((word if place is None else back[word >> HALF].astype(U) | ((word & MASK) << HALF)) + U(1))
    n = np.bincount(line, minlength=len(lines))
    sets = np.zeros(len(lines), U)
    with np.errstate(over="ignore"):
        if len(h):
            sets[n > 0] = np.add.reduceat(mixed, (np.cumsum(n) - n)[n > 0])
        return line, word, mixed, X.mix(sets + n.astype(U))


def low(sets: np.ndarray) -> np.ndarray:
    """The 32 bits of sets' hashes that are kept."""
    return (sets & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def counted(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by bucket, over all texts."""
    size = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, part in X.chunks(batch.column(0)):
                total += np.bincount(((X.words(part)[1] >> U(24)) & MASK).view(np.int64), minlength=BUCKETS)
        data = [X.varints(np.array([0]), total[a : a + size])[1] for a in range(0, BUCKETS, size)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(data), dtype=np.int32)), pa.array(data, pa.binary())], ["b", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own[b] = own.get(b, 0) + X.unvarints(data.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], ["b", "data"])

    out = np.zeros(BUCKETS, np.int64)
    parts = docs.select("t").mapInArrow(X.lean(count), "b int, data binary").repartition("b").mapInArrow(X.lean(summed), "b int, data binary")
    for r in parts.collect():
        out[r["b"] * size : (r["b"] + 1) * size] = np.frombuffer(r["data"], np.int64)
    return out


def least_overlap(threshold: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Words that sets of n and m must share."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


#: Packed columns of prefix words: 32 bits of the word (or of what else makes a group), set, change of document from the row before, line number, words of the line, place of the word with two flags (first row of its line; line of the last round), sketch.
COLUMNS = {"k": np.uint32, "s": np.int32, "d": np.int64, "l": np.int32, "n": np.int32, "p": np.int32, "b": U}


def packed(x: dict[str, np.ndarray]) -> bytes:
    """Prefix words of one bucket; `e`, the seven further words of the sketch, is kept as far as a set has them."""
    y = x | {"d": np.diff(x["d"], prepend=0)}
    more = [x["e"][x["n"] > least, a:b].tobytes() for least, a, b in zip(LEVELS, (0, 1, 3), (1, 3, 7), strict=True)]
    return b"".join([len(x["k"]).to_bytes(4, "little"), *(y[c].astype(t).tobytes() for c, t in COLUMNS.items()), *more])


def unpacked(data: list[memoryview]) -> dict[str, np.ndarray]:
    parts: list[dict[str, np.ndarray]] = []
    for x in data:
        n, at, own = int.from_bytes(x[:4], "little"), 4, {}
        for c, t in COLUMNS.items():
            size = n * np.dtype(t).itemsize
            own[c] = np.frombuffer(x[at : at + size], t)
            at += size
        own["d"] = np.cumsum(own["d"])
        own["e"] = np.zeros((n, 7), U)
        for least, a, b in zip(LEVELS, (0, 1, 3), (1, 3, 7), strict=True):
            wide = np.flatnonzero(own["n"] > least)
            size = len(wide) * (b - a) * 8
            own["e"][wide, a:b] = np.frombuffer(x[at : at + size], U).reshape(-1, b - a)
            at += size
        parts.append(own)
    return {c: np.concatenate([p[c] for p in parts]) for c in [*COLUMNS, "e"]}


def repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner, and number from 0, of n items for each owner."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def keyed(word: np.ndarray, n: np.ndarray, threshold: float, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines of n words, all in order: line, key, place and whether it is the first of the line, of what they are indexed by. hot: the place among buckets from which on words are hot."""
    start = np.cumsum(n) - n
    least = np.ceil(threshold * n - 1e-9).astype(np.int64)
    line, p = repeated(np.where(n > 0, n - least + 1, 0))
    at = start[line] + p
    common = ((word[at] >> HALF).astype(np.int64) >= hot) & (least[line] > 1)
    with np.errstate(over="ignore"):
        alone = np.flatnonzero(~common)
        out = [(line[alone], X.mix(word[at[alone]]), p[alone], p[alone] == 0)]
        if common.any():
            # Two words: the hot one and each later one among one more than the prefix.
            two = np.flatnonzero(common & (n[line] <= int(SHORT / threshold)))
            which, q = repeated((n - least + 1)[line[two]] - p[two])
            own = two[which]
            out.append((line[own], X.mix(X.mix(word[at[own]]) * U(3) + word[at[own] + q + 1]), p[own], (p[own] == 0) & (q == 0)))
            wide = np.flatnonzero(common & (n[line] > SHORT))
            size = np.floor(np.log(n[line[wide]]) / -np.log(threshold) + 1e-9).astype(np.int64) if threshold < 1 else n[line[wide]]
            for less in (0, 1):
                out.append((line[wide], X.mix(X.mix(word[at[wide]]) * U(5) + (size - less).astype(U)), p[wide], (p[wide] == 0) & (n[line[wide]] > int(SHORT / threshold)) & (less == 0)))
    line, key, p, first = (np.concatenate(x) for x in zip(*out, strict=True))
    return line, key, p, first


def prefixes(docs: DataFrame, frequency: np.ndarray, threshold: float, n_parts: int, hot: int) -> DataFrame:
    """b, data: packed prefix words of the bucket b, and in rows of kind 1 packed lines (d, l, s) that go since an earlier one in the same task has the same set. docs: d, t, and v: lines of the last round, or null."""
    order = np.lexsort((np.arange(BUCKETS), frequency))
    place = np.empty(BUCKETS, np.uint32)
    place[order] = np.arange(BUCKETS, dtype=np.uint32)
    back = order.astype(np.uint32)
    from_hot = int(np.searchsorted(frequency[order], hot, "right"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, dict]] = []
        waiting = base = 0

        def flushed() -> pa.RecordBatch:
            line, row = ({c: np.concatenate([h[k][c] for h in held]) for c in held[0][k]} for k in (0, 1))
            own = np.lexsort((line["l"], line["d"], line["n"], line["s"], line["b"]))
            v = {c: line[c][own] for c in ("s", "b", "n", "d", "l")}
            new = np.r_[True, (v["s"][1:] != v["s"][:-1]) | (v["b"][1:] != v["b"][:-1]) | (v["n"][1:] != v["n"][:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = np.flatnonzero((v["d"] != v["d"][first]) | (v["l"] != v["l"][first]))
            lead = np.zeros(len(own), bool)
            lead[own[new]] = True
            row = {c: x[lead[row["i"]]] for c, x in row.items()}
            bucket = (row["k"] % U(n_parts)).astype(np.int64)
            split = np.argsort(bucket.astype(np.uint16) if n_parts < 1 << 16 else bucket, kind="stable")
            ends = np.searchsorted(bucket[split], np.arange(n_parts + 1))
            some = np.flatnonzero(np.diff(ends))
            data = []
            for b in some:
                own = split[ends[b] : ends[b + 1]]
                i = row["i"][own]
                x = {c: line[c][i] for c in ("s", "d", "l", "n", "b", "e")} | {"k": ((row["k"][own] // U(n_parts)) & U(0xFFFFFFFF)), "p": row["p"][own] + line["f"][i]}
                data.append(packed(x))
            where, kind = some.astype(np.int32), np.zeros(len(some), np.int32)
            if len(gone):
                data.append(b"".join(v[c][gone].astype(t).tobytes() for c, t in (("d", np.int64), ("l", np.int32), ("s", np.int32))))
                where, kind = np.append(where, np.int32(int(v["d"][gone[0]]) % n_parts)), np.append(kind, np.int32(1))
            return pa.RecordBatch.from_arrays([pa.array(where), pa.array(kind), pa.array(data, pa.binary())], ["b", "kind", "data"])

        for batch in batches:
            ids, marked = np.asarray(batch.column(0)).astype(np.int64), batch.column(2)
            some_marked = marked.null_count < len(marked)
            for doc, number, lines in parted(batch.column(1)):
                line, word, mixed, sets = line_sets(lines, place, back)
                if not len(word):
                    continue
                n = np.bincount(line, minlength=len(lines))
                level = np.searchsorted(LEVELS, n)
                bits = np.zeros((len(n), 8), U)
                slot = (mixed >> U(61)).astype(np.int64) & ((1 << level[line]) - 1)
                turned = U(1) << ((mixed >> U(55)) & U(63))
                for k in range(1 << int(level.max())):
                    at = np.flatnonzero(slot == k)
                    if len(at):
                        begin = np.flatnonzero(np.r_[True, line[at[1:]] != line[at[:-1]]])
                        bits[line[at[begin]], k] = np.bitwise_xor.reduceat(turned[at], begin)
                i, k, p, first = keyed(word, n, threshold, from_hot)
                flag = np.zeros(len(n), np.int64)
                if some_marked:
                    last = {(r, a, b) for r in np.unique(doc).tolist() if marked[r].is_valid for a, b in zip(marked[r].values.field(0).to_pylist(), marked[r].values.field(1).to_pylist(), strict=True)}
                    flag[:] = [(r, a, b) in last for r, a, b in zip(doc.tolist(), number.tolist(), low(sets).tolist(), strict=True)]
                held.append(({"s": low(sets), "d": ids[doc], "l": number, "n": n, "b": bits[:, 0], "e": bits[:, 1:], "f": flag}, {"i": base + i, "k": k, "p": 4 * p + 2 * first}))
                held[-1][0]["n"] = np.where(n > 0, n, -1 - np.arange(base, base + len(n)))  # lines without words are like none
                base, waiting = base + len(n), waiting + len(k)
                if waiting >= ROWS:
                    yield flushed()
                    held, waiting, base = [], 0, 0
        if waiting:
            yield flushed()

    return docs.select("d", "t", "v").mapInArrow(X.lean(cut), "b int, kind int, data binary")


def possible(threshold: float, x: dict, early: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of lines may reach the threshold by place and sketch, and the sketches' difference in thousandths of their words."""
    n, m = x["n"][early], x["n"][late]
    need = least_overlap(threshold, n, m)
    left = np.flatnonzero(np.minimum(n - (x["p"][early] >> 2), m - (x["p"][late] >> 2)) >= need)
    early, late, both = early[left], late[left], (n + m)[left]
    level = np.searchsorted(LEVELS, np.minimum(x["n"][early], x["n"][late]))
    apart = np.zeros(len(left), np.int64)
    for k in range(4):
        at = np.flatnonzero(level == k)
        if len(at):
            apart[at] = np.bitwise_count(x["sketch"][k][early[at]] ^ x["sketch"][k][late[at]]).astype(np.int64).sum(1)
    own = apart <= both - 2 * need[left]
    return left[own], (1000 * apart[own] // both[own]).astype(np.int32)


def paired(rows: DataFrame, threshold: float, n_parts: int, partners: int, every: bool = False) -> DataFrame:
    """Later and earlier line of pairs (d, l, s; ad, al, as) with w: their difference by sketch, -1 if their sets are equal, -2 if the later line has more possible partners than are given (the earlier is then itself). every: all pairs of the lines of the last round."""
    names = [*KEY, *PARTNER, "w"]

    def emit(x: dict, early: np.ndarray, late: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x[c][late]) for c in KEY), *(pa.array(x[c][early]) for c in KEY), pa.array(w)], names)

    def compare(x: dict) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((x["l"], x["d"], x["s"], x["n"], x["k"]))
        x = {c: v[order] for c, v in x.items()}
        other = np.r_[True, x["k"][1:] != x["k"][:-1]]
        new = other | np.r_[True, (x["s"][1:] != x["s"][:-1]) | (x["n"][1:] != x["n"][:-1]) | (x["b"][1:] != x["b"][:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        equal = np.flatnonzero(~new & ((x["p"] & 2) > 0) & ((x["d"] != x["d"][first]) | (x["l"] != x["l"][first])))
        if not every and len(equal):
            yield emit(x, first[equal], equal, np.full(len(equal), -1, np.int32))
        group = np.cumsum(other)[new]
        x = {c: v[new] for c, v in x.items()}
        full = np.concatenate([x["b"][:, None], x.pop("e")], 1)
        x["sketch"] = [full]  # as of each level, folded
        for k in (4, 2, 1):
            full = full[:, :k] ^ full[:, k:]
            x["sketch"].insert(0, full)
        size = len(group)
        # Of the lines of a group, in order of length, each is compared with those after it that aren't too long.
        most = int(x["n"].max()) + 2
        code = group * most + x["n"]
        reach = np.searchsorted(code, np.minimum(group * most + np.floor(x["n"] / threshold + 1e-9).astype(np.int64), group * most + most - 1), "right")
        able = (x["p"] >> 2) <= x["n"] - np.ceil(2 * threshold / (1 + threshold) * x["n"] - 1e-9)
        count = np.where(able, reach - np.arange(size) - 1, 0)
        total = np.r_[0, np.cumsum(count)]
        hits = np.zeros(size, np.int64)
        some = np.flatnonzero(count)
        done = 0
        while done < len(some):
            to = max(done + 1, int(np.searchsorted(total[some], total[some[done]] + BLOCK, "right")) - 1)
            for lo in range(0, int(count[some[done]]), BLOCK) if to == done + 1 else (0,):  # a line of very many partners is cut
                own = some[done:to]
                early, step = repeated(np.minimum(count[own] - lo, BLOCK) if to == done + 1 else count[own])
                early = own[early]
                late = early + 1 + lo + step
                left, w = possible(threshold, x, early, late)
                early, late = early[left], late[left]
                swap = (x["d"][early] > x["d"][late]) | ((x["d"][early] == x["d"][late]) & ((x["l"][early] > x["l"][late]) | ((x["l"][early] == x["l"][late]) & (x["s"][early] > x["s"][late]))))
                early, late = np.where(swap, late, early), np.where(swap, early, late)
                if every:
                    marked = (x["p"][late] & 1) > 0
                    early, late, w = early[marked], late[marked], w[marked]
                elif len(late):
                    o = np.lexsort((w, late))
                    early, late, w = early[o], late[o], w[o]
                    at = np.flatnonzero(np.r_[True, late[1:] != late[:-1]])
                    many = np.diff(np.r_[at, len(late)])
                    rank = hits[late] + np.arange(len(late)) - np.repeat(at, many)
                    hits[late[at]] += many
                    kept = rank < partners
                    early, late, w = early[kept], late[kept], w[kept]
                if len(late):
                    yield emit(x, early, late, w)
            done = to
        over = np.flatnonzero(hits > partners)
        if len(over):
            yield emit(x, over, over, np.full(len(over), -2, np.int32))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for batch in batches:
            for kind, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not kind:
                    data.append(memoryview(x))
                elif not every:
                    n = len(x) // 16
                    own = [pa.array(np.frombuffer(x, t, n, at)) for t, at in ((np.int64, 0), (np.int32, 8 * n), (np.int32, 12 * n))]
                    yield pa.RecordBatch.from_arrays([*own, *own, pa.array(np.full(n, -1, np.int32))], names)
        if data:
            x = unpacked(data)
            data.clear()
            yield from compare(x)

    return rows.repartitionById(n_parts, "b").mapInArrow(X.lean(grouped), "d bigint, l int, s int, ad bigint, al int, as int, w int")


def verified(docs: DataFrame, pairs: DataFrame, threshold: float, most: int = 5000) -> DataFrame:
    """d, l, s of the later lines of pairs whose sets are similar enough. pairs: written.

    The sets of all lines that are compared with one earlier line meet in one place, at most about `most` with a copy of its.
    """
    pairs = pairs.select(*KEY, *PARTNER, F.xxhash64(*PARTNER).alias("g"))
    count = pairs.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > most)
    pairs = pairs.join(count, "g", "left").withColumn("z", F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.hash("d", "l"), F.ceil(F.col("c") / most).cast("int"))))
    visits = pairs.selectExpr("d", "l", "s", "g", "z", "1 as role").union(pairs.selectExpr("ad as d", "al as l", "as as s", "g", "z", "0 as role").distinct())
    visits = written(visits.groupBy("d").agg(F.collect_list(F.struct("l", "s", "g", "z", "role")).alias("v"), F.count("*").alias("c")), "visits")
    bulk = visits.agg(F.sum(24 + 32 * F.col("c"))).first()[0] or 0

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, visit = np.asarray(batch.column(0)).astype(np.int64), batch.column(2)
            for base, part in X.chunks(batch.column(1)):
                offsets, lines = X.split(part, "\n")
                own = visit.slice(base, len(part))
                row, inner = X.owners(np.asarray(own.offsets).astype(np.int64)), own.flatten()
                l, s, g, z, role = (np.asarray(inner.field(k)) for k in range(5))
                there = l < (offsets[row + 1] - offsets[row])  # else of another row of the same doc_id
                row, l, s, g, z, role = (v[there] for v in (row, l, s, g, z, role))
                for lo in range(0, len(row), ROWS):
                    cut = slice(lo, lo + ROWS)
                    want, which = np.unique(offsets[row[cut]] + l[cut], return_inverse=True)
                    line, word, _, found = line_sets(lines.take(pa.array(want)))
                    n = np.bincount(line, minlength=len(want))
                    start = np.cumsum(n) - n
                    at = np.flatnonzero(low(found)[which] == s[cut])
                    own_line, k = repeated(n[which[at]])
                    words = word[start[which[at]][own_line] + k]
                    raw = words.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()  # 40 bits each
                    ends = np.r_[0, 5 * np.cumsum(n[which[at]])].astype(np.int32)
                    blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                    at = at + lo
                    yield pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(z[at]), pa.array(role[at]), pa.array(ids[base + row[at]]), pa.array(l[at]), pa.array(s[at]), blobs], ["g", "z", "role", "d", "l", "s", "w"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of g, z, role: the earlier line first."""
        lead: pa.RecordBatch | None = None  # the earlier line that the batch before ended with
        for batch in batches:
            if not len(batch):
                continue
            if lead is not None:
                batch = pa.concat_batches([lead, batch])
            g, z, role = (np.asarray(batch.column(k)) for k in range(3))
            group = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (z[1:] != z[:-1])])
            first = np.searchsorted(group, group)
            lead = batch.slice(int(first[-1]), 1)
            offsets = np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset :][: len(g) + 1].astype(np.int64)
            raw = np.frombuffer(batch.column(6).buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            flat = np.zeros((len(raw) // 5, 8), np.uint8)
            flat[:, :5] = raw.reshape(-1, 5)
            offsets = (offsets - offsets[0]) // 5
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(g)), size)
            # A word of the batch, with its group: whether the group's first line has it.
            names, code = np.unique(flat.view(U).ravel(), return_inverse=True)
            code = group[owner] * max(1, len(names)) + code
            center = np.sort(code[(first[owner] == owner) & (role[owner] == 0)])
            at = np.minimum(np.searchsorted(center, code), max(0, len(center) - 1))
            hit = center[at] == code if len(center) else np.zeros(len(code), bool)
            common = np.bincount(owner, hit, len(g))
            kept = np.flatnonzero((role == 1) & (role[first] == 0) & (common >= threshold * (size + size[first] - common) - 1e-9))
            if len(kept):
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept)) for k in (3, 4, 5)], KEY)

    rows = docs.join(small(visits.select("d", "v"), bulk, 1), "d").select("d", "t", "v").mapInArrow(X.lean(sets), "g bigint, z int, role int, d bigint, l int, s int, w binary")
    return rows.repartition("g", "z").sortWithinPartitions("g", "z", "role").mapInArrow(X.lean(compare), "d bigint, l int, s int").distinct()


def wanted(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """d, l, s, w: lines with the packed words of their sets. docs: d, t. lines: d, l, s, written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, d, own in zip(batch.column(1), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = text.as_py().split("\n")
                own = [x for x in own if x["l"] < len(parts)]
                line, word, _, found = line_sets(pa.array([parts[x["l"]] for x in own], pa.large_string()))
                ends = np.searchsorted(line, np.arange(len(own) + 1))
                rows = [(d, x["l"], x["s"], word[a:b].tobytes()) for x, a, b, f in zip(own, ends[:-1], ends[1:], low(found), strict=True) if f == x["s"]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["d", "l", "s", "w"])

    by = lines.groupBy("d").agg(F.collect_list(F.struct("l", "s")).alias("v"))
    return docs.join(small(written(by, "wanted"), 24 * lines.count(), 1), "d").select("d", "t", "v").mapInArrow(X.lean(sets), "d bigint, l int, s int, w binary")


def with_buckets(lines: pa.Array, wanted: np.ndarray) -> np.ndarray:
    """Which lines have a word of the wanted buckets."""
    at, h = X.words(lines)
    hit = np.r_[0, np.cumsum(wanted[(h >> U(24)) & MASK])]
    return np.flatnonzero(hit[at[1:]] > hit[at[:-1]])


def against(docs: DataFrame, rows: list, frequency: np.ndarray, threshold: float) -> DataFrame:
    """d, l, s of the rows (d, l, s, w) that an earlier line of docs (d, t) is similar to: the rows' prefixes are looked up in each task."""
    order = np.lexsort((np.arange(BUCKETS), frequency))
    place = np.empty(BUCKETS, np.uint32)
    place[order] = np.arange(BUCKETS, dtype=np.uint32)
    back = order.astype(np.uint32)
    key = {c: np.array([r[c] for r in rows], np.int64) for c in KEY}
    size = np.array([len(r["w"]) // 8 for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r["w"] for r in rows), U)
    flat = np.sort((np.repeat(np.arange(len(rows)), size).astype(U) << U(40)) | (place[flat & MASK].astype(U) << HALF) | (flat >> HALF)) & U((1 << 40) - 1)
    ends = np.r_[0, np.cumsum(size)]
    which, k = repeated(size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)
    first = flat[ends[which] + k]
    by_word = np.argsort(first, kind="stable")
    first, which = first[by_word], which[by_word]
    wanted = np.zeros(BUCKETS, bool)
    wanted[back[first >> HALF]] = True

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = np.zeros(len(size), bool)
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            for doc, number, lines in parted(batch.column(1)):
                some = with_buckets(lines, wanted)  # others share no such word
                doc, number, lines = doc[some], number[some], lines.take(pa.array(some))
                line, word, _, sets = line_sets(lines, place, back)
                if not len(word):
                    continue
                n = np.bincount(line, minlength=len(lines))
                begin = np.cumsum(n) - n
                own, p = repeated(np.where(n > 0, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, 0))
                w = word[begin[own] + p]
                a, b = np.searchsorted(first, w), np.searchsorted(first, w, "right")
                at, step = repeated(b - a)
                pair = np.unique(own[at] * len(size) + which[a[at] + step])
                i, j = pair // len(size), pair % len(size)
                d, l, s = ids[doc[i]], number[i], low(sets)[i].astype(np.int64)
                early = (d < key["d"][j]) | ((d == key["d"][j]) & ((l < key["l"][j]) | ((l == key["l"][j]) & (s < key["s"][j]))))
                fit = np.flatnonzero(early & ~gone[j] & (np.minimum(n[i], size[j]) >= threshold * np.maximum(n[i], size[j]) - 1e-9))
                there = (line.astype(U) << U(40)) | word
                for lo in range(0, len(fit), 4096):
                    x, y = i[fit[lo : lo + 4096]], j[fit[lo : lo + 4096]]
                    owner, k = repeated(size[y])
                    q = (x[owner].astype(U) << U(40)) | flat[ends[y][owner] + k]
                    found = np.minimum(np.searchsorted(there, q), len(there) - 1)
                    common = np.bincount(owner, there[found] == q, len(x))
                    gone[y[common >= threshold * (n[x] + size[y] - common) - 1e-9]] = True
        some = np.flatnonzero(gone)
        yield pa.RecordBatch.from_arrays([pa.array(key["d"][some]), pa.array(key["l"][some].astype(np.int32)), pa.array(key["s"][some].astype(np.int32))], KEY)

    return docs.select("d", "t").mapInArrow(X.lean(look), "d bigint, l int, s int").distinct()


def removals(docs: DataFrame, threshold: float = 0.8, hot: int = HOT, partners: int = PARTNERS, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """d, l, s of the lines that go: doc_id, line number from 0, and 32 bits of the hash of the line's set."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string").alias("t")).where("d is not null and t is not null")
    limit_batches(docs.sparkSession)
    frequency = counted(own)
    n_parts = 1 + int(frequency.sum()) // 4 * ROW_BYTES // PART_BYTES
    none = F.lit(None).cast("array<struct<l:int,s:int>>")
    pairs = written(paired(prefixes(own.withColumn("v", none), frequency, threshold, n_parts, hot), threshold, n_parts, partners), "pairs")
    gone = written(pairs.where("w = -1").select(*KEY).distinct(), "equal")
    # First the partner that is nearest, then all that are known, then those that there were too many of.
    best = pairs.where("w <> -1").groupBy(*KEY).agg(F.min(F.when(F.col("w") >= 0, F.struct("w", *PARTNER))).alias("a"), F.min("w").alias("more"))
    best = written(best.join(gone, KEY, "left_anti").select(*KEY, "a.ad", "a.al", "a.as", "more"), "best")
    first = best.where("ad is not null")
    done = written(verified(own, first, threshold), "done")
    open_ = best.join(done, KEY, "left_anti").select(*KEY, F.col("ad").alias("bd"), F.col("al").alias("bl"), F.col("as").alias("bs"), "more")
    second = pairs.where("w >= 0").join(open_, KEY).where("ad <> bd or al <> bl or as <> bs").select(*KEY, *PARTNER).distinct()
    second = written(second, "second")
    if second.head(1):
        done = done.union(written(verified(own, second, threshold), "second-done"))
    out = gone.union(done)
    left = written(best.where("more = -2").select(*KEY).join(done, KEY, "left_anti"), "left")
    n = left.count()
    sets = written(wanted(own, left), "left-sets") if n else None
    if n and sets.agg(F.sum(F.octet_length("w") + 16)).first()[0] <= broadcast:
        out = out.union(against(own, sets.collect(), frequency, threshold))
    elif n:
        marks = left.groupBy("d").agg(F.collect_list(F.struct("l", "s")).alias("v"))
        marked = own.join(small(written(marks, "marks"), 24 * n, 1), "d", "left").select("d", "t", "v")
        again = paired(prefixes(marked, frequency, threshold, n_parts, hot), threshold, n_parts, partners, True)
        out = out.union(verified(own, written(again.select(*KEY, *PARTNER).distinct(), "again"), threshold))
    return out.distinct()


def dedup(docs: DataFrame, threshold: float = 0.8, hot: int = HOT, partners: int = PARTNERS, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """The rows and columns of docs, text without the lines that go, and __removed: how many went (0 where none)."""
    lines = written(removals(docs, threshold, hot, partners, broadcast), "removals")
    bulk = 24 * lines.count()
    twice = docs.groupBy(F.col("doc_id").cast("bigint").alias("d")).agg((F.count("*") > 1).alias("twice")).where("twice")
    gone = lines.join(twice, "d", "left").groupBy(F.col("d").alias("__d")).agg(F.collect_list(F.struct("l", "s")).alias("__gone"), F.max("twice").alias("__twice"))
    gone = written(gone, "gone")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())])

    @F.arrow_udf(schema)
    def rest(texts: pa.Array, numbers: pa.Array, sets: pa.Array, twice: pa.Array) -> pa.Array:
        text, removed = texts, np.zeros(len(texts), np.int32)
        changed = np.flatnonzero(np.asarray(texts.is_valid()) & np.asarray(numbers.is_valid()))
        new = []
        for i in changed.tolist():
            lines, drop = texts[i].as_py().split("\n"), numbers[i].as_py()
            if twice[i].as_py():  # rows of one doc_id: only the lines that were meant
                own = low(np.concatenate([line_sets(pa.array(lines[a : a + LINES], pa.large_string()))[3] for a in range(0, len(lines), LINES)]))
                drop = [a for a, b in zip(drop, sets[i].as_py(), strict=True) if a < len(lines) and own[a] == b]
            drop = set(drop)
            new.append("\n".join(x for a, x in enumerate(lines) if a not in drop))
            removed[i] = len(drop)
        if len(changed):
            mask = np.zeros(len(texts), bool)
            mask[changed] = True
            text = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
        X.trimmed()
        return pa.StructArray.from_arrays([text, pa.array(removed)], ["text", "removed"])

    joined = docs.join(small(gone, bulk, 1), docs["doc_id"].cast("bigint") == F.col("__d"), "left")
    text = F.col("text").cast("string")
    # Texts that nothing is taken from don't go through Python.
    joined = joined.withColumn("__new", rest(F.when(F.col("__gone").isNotNull(), text), F.col("__gone.l"), F.col("__gone.s"), F.coalesce("__twice", F.lit(False))))
    columns = [F.coalesce("__new.text", text).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.col("__new.removed").alias("__removed"))
