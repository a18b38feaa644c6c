"""SentencePiece encoding by a relational Viterbi lattice, and decoding.

The vocabulary is a .model file, given by its path. A piece's log probability is the score in the file if it is a unigram
model, as the file itself says; a BPE file has only merge ranks, which become log probabilities by Zipf's law, -ln(rank) - ln(sum of 1 / rank).
Scores are in 1/256, so that sums are exact. The encoding is the most probable sequence of pieces, of equals the one that
has the longer last piece; a character without a piece costs 10 more than the worst piece and becomes its UTF-8 bytes. This
is what the sentencepiece library gives for the same pieces in a unigram model (of texts of some 5,000 pieces and more its
32-bit sums are rounded, and choose otherwise between near equals). It isn't the sequence that the BPE merges
of the same file give: for that, run them.

Texts are cut where no piece can reach over: before a space that follows something else, and between two characters that
are nowhere adjacent in the vocabulary. What is left are short units, few of them distinct. For each distinct unit all
substrings up to the longest piece are exploded and equi-joined to the table of pieces; the edges are grouped by unit and
folded, in order of their ends, by a higher-order aggregate that keeps the best way to each place.

Texts aren't shuffled: a batch of them is a chunk with numbered units, its documents are sequences of small numbers, and
what is shuffled are a chunk's distinct units, their pieces, and those numbers.

Defined results: a null text has null ids, an empty one none. Line breaks and unknown characters come back exactly; U+2581
is a space to the library, and comes back as one. A text without any cut costs its length, as others do. Texts are read
twice: what isn't a mere scan of files is written first. Decoding ignores ids that the vocabulary doesn't have. Repeated rows are
encoded each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from . import text as X
from .shared import BROADCAST_BYTES, written
from .shared import batches as limit_batches
from .text import unvarints, varints

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 0xFFFF
ROWS = 512  # documents that are put together at once
BLOCK = 64  # characters that are folded at once
SCORES = 1 << 17  # scores are below that, and above its negative
CHUNK_BYTES = 8 << 20
SPLIT_BYTES = 1 << 20  # of a chunk that are split at once
CUT_BYTES = 1 << 18  # of distinct parts that are cut into units at once
BUCKETS_A_UNIT = 256  # of so many buckets a unit is in one


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with id and score in 1/256; the score of an unknown character; ids of bytes; adjacent characters."""

    pieces: dict[str, tuple[int, int]]
    unknown: int
    bytes: tuple[int, ...]
    adjacent: np.ndarray
    size: int

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def is_bpe(path: str) -> bool:
    """Whether the file says that its model is one of merges."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type == proto.trainer_spec.BPE


def vocabulary(path: str = MODEL, bpe: bool | None = None) -> Vocabulary:
    """The pieces of a model with byte fallback. bpe: whether scores are merge ranks, in order of id; by default what the file says."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bpe = is_bpe(path) if bpe is None else bpe
    size = model.get_piece_size()
    if size > UNKNOWN:
        raise ValueError(f"at most {UNKNOWN} pieces can be packed")
    own = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = np.log(np.sum(1.0 / np.arange(1, len(own) + 1)))
    scores = {i: round(256 * (-np.log(k + 1) - total if bpe else model.get_score(i))) for k, i in enumerate(own)}
    if max(scores.values()) >= SCORES or min(scores.values()) - 2560 <= -SCORES:
        raise ValueError("a score can't be packed")
    byte = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
    pieces = {model.id_to_piece(i): (i, s) for i, s in scores.items()}
    adjacent = np.unique(np.array([(ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
    return Vocabulary(pieces, min(scores.values()) - 2560, tuple(byte[f"<0x{b:02X}>"] for b in range(256)), adjacent, size)


@dataclass
class Chunk:
    """Parts of texts: their numbers, in a row for each text; the units of each distinct part; the distinct units, by bucket, and where buckets end."""

    key: int
    offsets: np.ndarray
    parts: np.ndarray
    unit_offsets: np.ndarray
    unit_ids: np.ndarray
    units: pa.Array
    ends: np.ndarray


COMMON = 1 << 11
_common: dict[int, np.ndarray] = {}


def common(vocab: Vocabulary) -> np.ndarray:
    """Whether two characters below COMMON are adjacent in the vocabulary, as a table."""
    key = hash(vocab.adjacent.tobytes())
    if key not in _common:
        table = np.zeros(COMMON * COMMON, bool)
        a, b = vocab.adjacent >> 21, vocab.adjacent & 0x1FFFFF
        own = (a < COMMON) & (b < COMMON)
        table[a[own] * COMMON + b[own]] = True
        _common.clear()
        _common[key] = table
    return _common[key]


def spaced(offsets: np.ndarray, at: np.ndarray, own: pa.Array, content: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, parts and contents where texts with runs of spaces have parts of their own: a run belongs to the part after it."""
    row = X.owners(offsets)
    odd = np.unique(row[at == pc.index(own, "").as_py()])
    number: dict[str, int] = {}
    new = {}
    for r in odd:
        out, run = [], 0
        for p in content.take(pa.array(at[offsets[r] : offsets[r + 1]])).to_pylist():
            if p == SPACE:
                run += 1
            elif p[:1] == SPACE or not run:
                out.append(SPACE * run + p)
                run = 0
            else:
                out += [SPACE * run, p]
                run = 0
        if run and (out or run > 1):
            out.append(SPACE * run)
        new[r] = np.array([len(content) + number.setdefault(p, len(number)) for p in out], np.int64)
    length = np.diff(offsets)
    pieces, last = [], 0
    for r in odd:
        pieces += [at[offsets[last] : offsets[r]], new[r]]
        length[r] = len(new[r])
        last = r + 1
    return np.r_[0, np.cumsum(length)], np.concatenate([*pieces, at[offsets[last] :]]), pa.concat_arrays([content, pa.array(list(number), pa.large_string())])


def cuts(whole: bytes, ends: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Bytes where units begin in parts that end there: between characters that are nowhere adjacent. Whole parts are looked at, of CUT_BYTES together if no single one is larger."""
    begin, at, near = [], 0, common(vocab)
    while at < len(whole):
        to = int(ends[max(np.searchsorted(ends, at, "right"), np.searchsorted(ends, at + CUT_BYTES, "right") - 1)])
        own = whole[at:to]
        first = np.flatnonzero((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)  # bytes where characters begin
        points = np.frombuffer(own.decode().encode("utf-32-le"), np.int32)
        cut = np.ones(len(points), bool)
        low = np.minimum(points, COMMON - 1)
        cut[1:] = ~near[low[:-1] * COMMON + low[1:]]
        rare = np.flatnonzero((points[:-1] >= COMMON - 1) | (points[1:] >= COMMON - 1))
        cut[rare + 1] = ~np.isin((points[rare].astype(np.int64) << 21) | points[rare + 1], vocab.adjacent)
        inner = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, to)] - at
        cut[np.searchsorted(first, inner)] = True
        begin.append(first[cut] + at)
        at = to
    return np.concatenate(begin) if begin else np.empty(0, np.int64)


def chunk(texts: pa.Array, vocab: Vocabulary, n: int) -> Chunk:
    """The texts, null being '', in units of which pieces are made, these in n buckets by hash."""
    coded, ends = [], [np.zeros(1, np.int64)]
    for _, some in X.chunks(texts, SPLIT_BYTES) or [(0, X.filled(texts))]:
        offsets, parts = X.split(pc.replace_substring(pc.replace_substring(some, SPACE, " "), "\n", f" {SPACE}\n {SPACE}"), " ")
        coded.append(parts.dictionary_encode())
        ends.append(offsets[1:] + ends[-1][-1])
        del offsets, parts, some
    offsets, coded = np.concatenate(ends), pa.chunked_array(coded).unify_dictionaries().combine_chunks()
    at, own = np.asarray(coded.indices), coded.dictionary
    del coded
    X.trimmed()
    # A part's spaces: one before it, none if it begins with the mark that line breaks leave.
    space = pa.scalar(SPACE, pa.large_string())
    content = pc.if_else(pc.starts_with(own, SPACE), pc.utf8_slice_codeunits(own, 1), pc.binary_join_element_wise(space, own, pa.scalar("", pa.large_string())))
    if pc.index(own, "").as_py() >= 0:
        offsets, at, content = spaced(offsets, at, own, content)
    # Frequent parts get small numbers.
    order = np.argsort(-np.bincount(at, minlength=len(content)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    at, content = place[at], content.take(pa.array(order))
    del own, order, place
    ends = np.cumsum(np.asarray(pc.binary_length(content)).astype(np.int64))
    whole = b"" if not len(content) or not ends[-1] else content.buffers()[2].to_pybytes()[: ends[-1]]
    begin = cuts(whole, ends, vocab)
    strings = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.r_[begin, len(whole)].astype(np.int64)), pa.py_buffer(whole)])
    units = strings.dictionary_encode()
    unit_offsets = np.searchsorted(begin, np.r_[0, ends])
    name = xxhash.xxh3_64(whole)
    name.update(at.tobytes())
    name.update(offsets.tobytes())
    key = int(np.uint64(name.intdigest()).astype(np.int64))
    # With many buckets a unit is in several, each for its share of the chunks: lists of where it occurs stay short.
    with np.errstate(over="ignore"):
        bucket = ((X.string_hashes(units.dictionary) + X.mix(np.full(1, key % max(1, n // BUCKETS_A_UNIT), np.uint64))) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Chunk(key, offsets, at, unit_offsets, place[np.asarray(units.indices)], units.dictionary.take(pa.array(order)), np.searchsorted(bucket[order], np.arange(n + 1)))


def piece_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    # Of an Arrow table, so that no Python worker has to read it.
    columns = {"p": (list(vocab.pieces), pa.string()), "id": ([i for i, _ in vocab.pieces.values()], pa.int32()), "score": ([s for _, s in vocab.pieces.values()], pa.int32())}
    table = spark.createDataFrame(pa.table({c: pa.array(v, t) for c, (v, t) in columns.items()}))
    return F.broadcast(table) if sum(80 + 2 * len(p) for p in vocab.pieces) <= BROADCAST_BYTES else table


def edges(units: DataFrame, vocab: Vocabulary) -> DataFrame:
    """b, u, k, t, x: an edge of the lattice of unit u that ends in its k-th block of BLOCK characters, packed: end in the block, 31 - length, score, id. t, the unit and where it occurs, is carried by one edge of a unit."""
    n = vocab.longest
    if n > 31:
        raise ValueError("pieces of at most 31 characters can be packed")
    # A block goes with the characters after it that its pieces may reach, so that no substring is looked for in a long text.
    blocks = F.expr(f"if(length(w) <= {BLOCK}, array(w), regexp_extract_all(w, '(?s).{{1,{BLOCK}}}', 0))")
    block = "named_struct('k', i, 'text', concat(x, left(coalesce(get(parts, i + 1), ''), 30)), 't', if(i = 0, named_struct('w', w, 'o', o), null))"
    spread = units.withColumn("parts", blocks).select("b", "u", F.expr(f"explode(transform(parts, (x, i) -> {block})) as y")).select("b", "u", "y.*")
    spread = spread.select("b", "u", "k", "text", "t", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.length("text")) - 1)).alias("s"))
    spread = spread.select("b", "u", "k", "text", "s", F.when(F.col("s") == 0, F.col("t")).alias("t"), F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.length("text") - F.col("s")))).alias("l"))
    spread = spread.select("b", "u", "k", (F.col("s") + F.col("l") - 1).alias("e"), "l", F.when(F.col("l") == 1, F.col("t")).alias("t"), F.expr("substring(text, s + 1, l)").alias("p"))
    joined = spread.join(piece_table(units.sparkSession, vocab), "p", "left").where("id is not null or l = 1")
    packed = F.expr(
        f"shiftleft(cast(e % {BLOCK} as bigint), 39) | shiftleft(cast(31 - l as bigint), 34) | shiftleft(cast(coalesce(score, {vocab.unknown}) + {SCORES} as bigint), 16) | cast(coalesce(id, {UNKNOWN}) as bigint)"
    )
    return joined.select("b", "u", F.expr(f"k + cast(e div {BLOCK} as int)").alias("k"), "t", packed.alias("x"))


def folded(lattice: DataFrame, vocab: Vocabulary) -> DataFrame:
    """o, ids: the best pieces of each unit.

    The fold has for each place the score, and how it is reached: start and id. It goes from block to block with the last 31
    places alone, so that a unit costs its length and not the square of it.
    """
    grouped = lattice.groupBy("u", "b", "k").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.first("t", True).alias("t"))
    grouped = grouped.groupBy("u", "b").agg(F.sort_array(F.collect_list(F.struct("k", "xs"))).alias("ys"), F.first("t", True).alias("t"))
    way = "cast(array() as array<array<struct<{}s:int,id:int>>>)"
    end, size = "(size(z.c) + cast(shiftright(x, 39) as int))", "(31 - cast(shiftright(x, 34) & 31 as int))"
    total = f"(a[{end} - {size}].score + (shiftright(x, 16) & {2 * SCORES - 1}) - {SCORES})"
    edge = f"array(named_struct('score', {total}, 's', {BLOCK} * y.k + 1 + cast(shiftright(x, 39) as int) - {size}, 'id', cast(x & 65535 as int)))"
    best = grouped.select(
        F.col("t.w").alias("w"), F.col("t.o").alias("o"),
        F.expr(f"""aggregate(ys, named_struct('c', array(named_struct('score', 0L, 's', -1, 'id', -1)), 'out', {way.format("score:bigint,")}), (z, y) ->
            aggregate(y.xs, z.c, (a, x) -> if(size(a) = {end}, concat(a, {edge}), if({total} > a[{end}].score, concat(slice(a, 1, {end}), {edge}), a)),
            a -> named_struct('c', slice(a, greatest(size(a) - 30, 1), 31), 'out', concat(z.out, array(slice(a, size(z.c) + 1, {BLOCK}))))), z -> z.out)""").alias("a"),
    )
    block = "a[size(a) - i]"
    way = best.select(
        "w", "o",
        F.expr(f"""aggregate(sequence(1, size(a)), named_struct('at', {BLOCK} * (size(a) - 1) + size(a[size(a) - 1]), 'out', {way.format("")}), (z, i) ->
            aggregate(sequence(1, size({block})), named_struct('at', z.at, 'o', cast(array() as array<struct<s:int,id:int>>)), (v, j) ->
            if(v.at <= {BLOCK} * (size(a) - i), v, named_struct('at', {block}[v.at - 1 - {BLOCK} * (size(a) - i)].s, 'o', array_append(v.o, named_struct('s', {block}[v.at - 1 - {BLOCK} * (size(a) - i)].s, 'id', {block}[v.at - 1 - {BLOCK} * (size(a) - i)].id)))),
            v -> named_struct('at', v.at, 'out', concat(array(reverse(v.o)), z.out))), z -> flatten(z.out))""").alias("way"),
    )
    first = vocab.bytes[0]
    if vocab.bytes != tuple(range(first, first + 256)):
        raise ValueError("bytes need consecutive ids")
    known = F.expr(f"not exists(way, y -> y.id = {UNKNOWN})")
    spelt = F.expr(
        f"""flatten(transform(way, y -> if(y.id <> {UNKNOWN}, array(y.id), transform(sequence(1, octet_length(substring(w, y.s + 1, 1))),
        k -> {first} + cast(conv(substring(hex(encode(substring(w, y.s + 1, 1), 'utf-8')), 2 * k - 1, 2), 16, 10) as int)))))"""
    )
    return way.select("o", F.when(known, F.expr("transform(way, y -> y.id)")).otherwise(spelt).alias("ids"))


STEADY = {"FileSourceScanExec", "ProjectExec", "FilterExec", "ColumnarToRowExec", "WholeStageCodegenExec", "InputAdapter"}


def steady(docs: DataFrame) -> DataFrame:
    """docs, if it is but a scan of files, which gives the same batches each time it is read; else written first."""
    nodes = [docs._jdf.queryExecution().executedPlan()]
    for node in nodes:
        if node.getClass().getSimpleName() not in STEADY:
            return written(docs, "texts")
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return docs


def encode(docs: DataFrame, vocab: Vocabulary | None = None, partitions: int | None = None, back: str | None = None) -> DataFrame:
    """doc_id, ids: one row for each row of docs. back: path of a model, to add `decoded`, the text that the ids stand for."""
    vocab = vocab or vocabulary()
    spell = Speller(back) if back else None
    spark = docs.sparkSession
    limit_batches(spark, CHUNK_BYTES)
    n = partitions or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = steady(docs.select(F.col("doc_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in X.chunks(batch.column(1), CHUNK_BYTES):
                c = chunk(part, vocab, n)
                some = np.flatnonzero(np.diff(c.ends))
                offsets = pa.array(np.r_[c.ends[some], len(c.units)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), c.key)), pa.array(c.ends[some].astype(np.int32)), pa.ListArray.from_arrays(offsets, c.units.cast(pa.string()))], ["b", "c", "first", "w"]
                )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, part in X.chunks(batch.column(1), CHUNK_BYTES):
                c = chunk(part, vocab, n)
                at, data = varints(c.offsets, c.parts)
                codes = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])
                table = varints(np.array([0, len(c.unit_ids)]), c.unit_ids)[1]
                sizes = varints(np.array([0, len(c.unit_offsets) - 1]), np.diff(c.unit_offsets))[1]
                kind = np.r_[1, 2, np.where(np.asarray(batch.column(1).slice(base, len(part)).is_null()), 4, 3)].astype(np.int32)
                ids = pa.concat_arrays([pa.nulls(2, pa.int64()), batch.column(0).slice(base, len(part)).cast(pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kind), c.key)), pa.array(kind), ids, pa.concat_arrays([pa.array([sizes, table], pa.binary()), codes])], ["c", "kind", "i", "data"]
                )

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encoded units by chunk: numbers, counts of pieces, pieces."""
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def packed() -> pa.RecordBatch:
            key, unit, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            start = np.cumsum(size) - size
            order = np.lexsort((unit, key))
            key, unit, size, start = key[order], unit[order], size[order], start[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            blobs = []
            for a, b in zip(at, np.r_[at[1:], len(key)], strict=True):
                which = np.repeat(start[a:b] - np.r_[0, np.cumsum(size[a:b])[:-1]], size[a:b]) + np.arange(size[a:b].sum())
                head = varints(np.array([0, 2 * (b - a)]), np.concatenate([np.diff(unit[a:b], prepend=0), size[a:b]]))[1]
                blobs.append(len(head).to_bytes(4, "little") + head + flat[which].astype(np.uint16).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.zeros(len(at), np.int32)), pa.nulls(len(at), pa.int64()), pa.array(blobs, pa.binary())], ["c", "kind", "i", "data"])

        for batch in batches:
            if not len(batch):
                continue
            occ, ids = batch.column(0), batch.column(1)
            many = np.diff(np.asarray(occ.offsets))
            inner = occ.flatten()
            size = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            which = np.repeat(np.arange(len(many)), many)
            start = np.cumsum(size) - size
            each = size[which]
            flat = np.asarray(ids.flatten())[np.repeat(start[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            held.append((np.asarray(inner.field("c")), np.asarray(inner.field("k")).astype(np.int64), each, flat))
            waiting += len(each)
            if waiting > 1_000_000:
                yield packed()
                held, waiting = [], 0
        if held:
            yield packed()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told_, sizes, table = None, [], None, None
        for batch in batches:
            key, kind, ids, data = (batch.column(k) for k in range(4))
            key, kind = np.asarray(key), np.asarray(kind)
            if not len(key):
                continue
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (np.minimum(kind[1:], kind[:-1]) < 3)])
            for a, b in zip(cut, np.r_[cut[1:], len(key)], strict=True):
                if key[a] != now:
                    now, told_, sizes, table = key[a], [], None, None
                if kind[a] == 0:
                    told_.append(data[a].as_py())
                elif kind[a] == 1:
                    sizes = unvarints(data[a].as_py())
                elif kind[a] == 2:
                    table = expanded(told_, unvarints(data[a].as_py()), sizes)
                else:
                    for lo in range(a, b, ROWS):
                        out = spelled(table, ids.slice(lo, min(ROWS, b - lo)), data.slice(lo, min(ROWS, b - lo)), kind[lo : min(lo + ROWS, b)] == 4)
                        yield out if spell is None else pa.RecordBatch.from_arrays([*out.columns, spell(out.column(1))], ["doc_id", "ids", "decoded"])

    units = own.mapInArrow(X.lean(number), "b int, c bigint, first int, w array<string>").repartition(n, "b")
    units = units.select("b", "c", "first", F.posexplode("w").alias("k", "w")).select("b", "w", F.struct("c", (F.col("first") + F.col("k")).alias("k")).alias("o"))
    units = units.groupBy("b", "w").agg(F.collect_list("o").alias("o")).withColumn("u", F.monotonically_increasing_id())
    words = folded(edges(units, vocab), vocab).mapInArrow(X.lean(told), "c bigint, kind int, i bigint, data binary")
    rows = own.mapInArrow(X.lean(coded), "c bigint, kind int, i bigint, data binary")
    return words.unionByName(rows).repartition(n, "c").sortWithinPartitions("c", "kind").mapInArrow(X.lean(joined), "doc_id bigint, ids array<int>" + ", decoded string" * bool(back))


def expanded(blobs: list[bytes], units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of the pieces of each part of a chunk, and the pieces."""
    number, count, flat = [], [], []
    for blob in blobs:
        head = int.from_bytes(blob[:4], "little")
        both = unvarints(blob[4 : 4 + head])
        number.append(np.cumsum(both[: len(both) // 2]))
        count.append(both[len(both) // 2 :])
        flat.append(np.frombuffer(blob[4 + head :], np.uint16))
    n = int(units.max()) + 1 if len(units) else 0
    size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if number:
        at, each = np.concatenate(number), np.concatenate(count)
        size[at], start[at] = each, np.cumsum(each) - each
    if n and not size.all():
        raise RuntimeError("a chunk was read differently the second time: write its input to a table first")
    pieces = np.concatenate(flat) if flat else np.empty(0, np.uint16)
    each = size[units]
    out = pieces[np.repeat(start[units] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    ends = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(sizes)]]
    return ends[:-1], np.diff(ends), out


def spelled(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: pa.Array, codes: pa.Array, null: np.ndarray) -> pa.RecordBatch:
    """Documents' ids from the pieces of their chunk's parts and the numbers of their parts."""
    start, size, flat = table
    raw = b"".join(codes.to_pylist())
    ends = np.cumsum(np.asarray(pc.binary_length(codes)))
    parts = unvarints(raw)
    last = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0x80)
    offsets = np.r_[0, np.searchsorted(last, ends - 1, "right")] if len(last) else np.zeros(len(ids) + 1, np.int64)
    each = size[parts]
    total = np.r_[0, np.cumsum(each)]
    out = flat[np.repeat(start[parts] - total[:-1], each) + np.arange(total[-1])]
    lists = pa.ListArray.from_arrays(pa.array(total[offsets].astype(np.int32)), pa.array(out.astype(np.int32)), mask=pa.array(null))
    return pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "ids"])


class Speller:
    """Turns arrays of ids into texts."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        table = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        self.length = np.array([len(x) for x in table] + [0])
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, column: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(column), ROWS):
            part = column.slice(lo, ROWS)
            own = np.asarray(part.flatten())
            own = np.where((own >= 0) & (own < self.size), own, self.size)
            each = self.length[own]
            total = np.r_[0, np.cumsum(each)]
            raw = self.data[np.repeat(self.start[own] - total[:-1], each) + np.arange(total[-1])].tobytes()
            at = total[np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part), 0)))]]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            out += [None if no else t[1:] if t[:1] == " " else t for t, no in zip(texts, np.asarray(part.is_null()), strict=True)]
        return pa.array(out, pa.string())


def decode(ids: Column, path: str = MODEL) -> Column:
    """The text that ids stand for; null for null."""
    spell = Speller(path)

    @F.arrow_udf(T.StringType())
    def spelt(column: pa.Array) -> pa.Array:
        return spell(column)

    return spelt(ids)
