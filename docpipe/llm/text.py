"""Word hashing over Arrow batches: whole texts, vectorised, no row-at-a-time Python."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = ".,;:!?\"'()[]{}<>|*$&%#@~`^_=+/\\-–—…«»“”‘’¡¿"
U64 = np.uint64
STRINGS = 1 << 14  # that are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split(texts: pa.Array, pattern: str | None = None) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat parts; at ASCII white space, or at a literal pattern."""
    parts = pc.ascii_split_whitespace(texts) if pattern is None else pc.split_pattern(texts, pattern)
    return np.asarray(parts.offsets).astype(np.int64) - parts.offsets[0].as_py(), parts.flatten()


def string_hashes(strings: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes: bytes times random numbers by place, summed and mixed; two strings agree with a chance of 2**-56."""
    if len(strings) > STRINGS:
        return np.concatenate([string_hashes(strings.slice(k, STRINGS)) for k in range(0, len(strings), STRINGS)])
    _, offsets, data = strings.buffers()
    if not len(strings) or data is None:
        return np.zeros(len(strings), U64)
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    length = np.diff(at)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], length)
    with np.errstate(over="ignore"):
        random = mix(np.arange(1, int(length.max()) + 2, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        out = length.astype(U64)
        some = length > 0
        if some.any():
            out[some] += np.add.reduceat((raw.astype(U64) + U64(1)) * random[place], (at[:-1] - at[0])[some])
        return mix(out + U64(0x632BE59BD9B4E019))


def hashes(parts: pa.Array, trim: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each part its hash, and whether anything is left of it. trim: lower case, without outer punctuation."""
    if len(parts) == 0:
        return np.empty(0, U64), np.empty(0, bool)
    coded = parts.dictionary_encode()
    own = coded.dictionary
    if trim:
        own = pc.utf8_trim(pc.utf8_lower(own), characters=PUNCTUATION)
    at = np.asarray(coded.indices)
    return string_hashes(own)[at], np.asarray(pc.binary_length(own))[at] > 0


SPACE, OUTER = 1, 2
EMPTY, BLANK = (pa.scalar(x, pa.large_string()) for x in ("", " "))
KINDS = np.zeros(256, np.uint8)
KINDS[[ord(c) for c in PUNCTUATION if ord(c) < 128]] = OUTER
KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
LONGER = {c.encode() for c in PUNCTUATION if ord(c) > 127}
FACTOR = 0x9E3779B97F4A7C15
SEGMENT = 1 << 17  # bytes that are hashed at once
LETTERS = mix(np.arange(1, 257, dtype=U64) * U64(FACTOR))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.r_[U64(1), np.full(n - 1, f % (1 << 64), U64)]) for f in (FACTOR, pow(FACTOR, -1, 1 << 64))]
    return _powers[0], _powers[1]


def plain_kinds(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(bytearray(raw.tobytes().translate(KINDS.tobytes())), np.uint8)


def kinds(raw: np.ndarray) -> np.ndarray:
    """For each byte whether it is white space, outer punctuation or neither."""
    kind = plain_kinds(raw)
    for lead, size in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(raw == lead)
        at = at[at + size <= len(raw)]
        own = [c for c in LONGER if len(c) == size]
        if len(at):
            hit = np.zeros(len(at), bool)
            for c in own:
                hit |= np.logical_and.reduce([raw[at + k] == c[k] for k in range(1, size)])
            for k in range(size):
                kind[at[hit] + k] = OUTER
    return kind


def trimmed_ends(kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words first..last without outer punctuation; last <= first if nothing is left."""
    first, last = first.copy(), last.copy()
    before, after = np.flatnonzero(kind[first] == OUTER), np.flatnonzero(kind[last - 1] == OUTER)
    for _ in range(4):
        first[before] += 1
        last[after] -= 1
        before, after = before[kind[first[before]] == OUTER], after[kind[last[after] - 1] == OUTER]
        before, after = before[first[before] < last[before]], after[first[after] < last[after]]
    at = np.union1d(before, after)
    if len(at):  # long runs of punctuation
        core = np.flatnonzero(kind == 0)
        a, b = np.searchsorted(core, first[at]), np.searchsorted(core, last[at])
        some = a < b
        last[at[~some]] = first[at[~some]]
        first[at[some]], last[at[some]] = core[a[some]], core[b[some] - 1] + 1
    return first, last


def words(column: pa.Array, trim: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and hashes of the words of each text, at ASCII white space. trim: lower case, without outer punctuation; words of nothing else are dropped.

    A word's hash is a polynomial of random numbers for its bytes, from running sums over the whole batch, and mixed.
    """
    texts = filled(column)
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, U64)
    texts = pc.binary_join_element_wise(pc.utf8_lower(texts) if trim else texts, EMPTY, BLANK)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    kind = kinds(raw) if trim else plain_kinds(raw)
    space = kind == SPACE
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    first, last = edge[::2], edge[1::2]
    text = np.searchsorted(first, at - at[0])
    if trim:
        a, b = trimmed_ends(kind, first, last)
        left = a < b
        if left.all():
            first, last = a, b
        else:
            text = np.r_[0, np.cumsum(left)][text]
            first, last = a[left], b[left]
    h = np.empty(len(first), U64)
    done = 0
    while done < len(first):
        base = first[done]
        to = max(done + 1, int(np.searchsorted(last, base + SEGMENT, "right")))
        size = int(last[to - 1] - base)
        up, down = powers(max(size, SEGMENT) + 1)
        sums = np.zeros(size + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(LETTERS[raw[base : base + size]] * up[:size], out=sums[1:])
            own = first[done:to] - base
            h[done:to] = (sums[last[done:to] - base] - sums[own]) * down[own]
        done = to
    with np.errstate(over="ignore"):
        return text, mix(h + (last - first).astype(U64))


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each flat item the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def grams(offsets: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all n-grams of consecutive words; a gram starts where its row has n words left."""
    if len(h) < n:
        return np.empty(0, np.int64), np.empty(0, U64)
    row = owners(offsets)
    full = row[: len(h) - n + 1] == row[n - 1 :]
    with np.errstate(over="ignore"):
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = mix(g * U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return row[: len(h) - n + 1][full], g[full]


def chunks(column: pa.Array, most: int = 2 << 20) -> list[tuple[int, pa.Array]]:
    """Slices of a column of texts, of at most so many bytes each if no single text is larger, with their first rows."""
    texts = filled(column)
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    out, at = [], 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        out.append((at, texts.slice(at, to - at)))
        at = to
    return out


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """An array<bigint> column."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def varints(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Numbers from 0, seven bits a byte, the last byte of each with the high bit: new offsets, and the bytes."""
    size = np.ones(len(values), np.int8)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size, dtype=np.int64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        at = size > k
        out[ends[at] - 1 - k] = (values[at] >> (7 * k)) & 0x7F
    out[ends - 1] |= 0x80
    return np.r_[0, ends][offsets], out.tobytes()


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw & 0x80)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    out = np.zeros(len(last), np.int64)
    size = last - first + 1
    for k in range(int(size.max()) if len(size) else 0):
        at = size > k
        out[at] |= (raw[last[at] - k] & np.uint8(0x7F)).astype(np.int64) << (7 * k)
    return out


def trimmed() -> None:
    """Gives freed memory back to the system, where there is a way."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def lean(make):
    """A function for mapInArrow whose worker gives its memory back at the end: workers stay, and many stages share an executor."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from make(batches)
        trimmed()

    return run
