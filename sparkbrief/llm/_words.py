"""Whole-batch text handling over Arrow's UTF-8 buffers with numpy; no per-word Python objects.

A ``Chunk`` is a run of documents whose bytes lie in one array. Words, lines and rolling hashes are found for the
whole chunk at once, in memory bounded by ``CHUNK_BYTES`` (a single longer text makes a chunk of its own, of which
a few flags a byte and a few longs a word are held). Hashes are taken ``SEGMENT`` values at a time, so the tables of
powers, the only thing kept between calls, are of one size whatever the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 512 << 10
#: Values that a step of a polynomial hash takes.
SEGMENT = 1 << 16
U64 = np.uint64

#: The bytes that part words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Fixed odd bases of the Rabin-Karp hashes; base - 1 is twice an odd number, so powers have a long period.
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB53)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finalizer of splitmix64)."""
    x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values(which: int) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64), 77 + which)
    v[SPACE] = 0
    return v


_BYTE = [_byte_values(0), _byte_values(1)]
_POW: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse modulo 2**64) for i < n. Tables of SEGMENT entries are kept, longer ones are not."""
    have = _POW.get((which, inverse))
    if have is None or len(have) < n:
        base = BASES[which]
        if inverse:
            base = pow(base, -1, 1 << 64)
        a = np.full(max(n, SEGMENT + 1), base, U64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if n <= SEGMENT + 1:
            _POW[which, inverse] = have
    return have[:n]


def spans(values: Callable[[int, int], np.ndarray], a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hashes of the values from a to b, for many intervals in order that do not overlap, each from its own start.

    ``values(lo, hi)`` gives the longs of a segment.
    """
    out = np.zeros(len(a), U64)
    up, down = powers(which, SEGMENT), powers(which, SEGMENT, inverse=True)
    lo = int(a[0]) if len(a) else 0
    end = int(b[-1]) if len(b) else 0
    while lo < end:
        i, j = np.searchsorted(b, lo, side="right"), np.searchsorted(a, lo + SEGMENT)
        if i < j:
            hi = min(lo + SEGMENT, int(b[j - 1]))
            p = np.zeros(hi - lo + 1, U64)
            np.cumsum(values(lo, hi) * up[: hi - lo], out=p[1:])
            x, y = np.maximum(a[i:j], lo) - lo, np.minimum(b[i:j], hi) - lo
            h = (p[y] - p[x]) * down[np.minimum(x, SEGMENT - 1)]
            if a[i] < lo:
                # the interval goes on from the segment before
                h[:1] *= U64(pow(BASES[which], lo - int(a[i]), 1 << 64))
            out[i:j] += h
        lo += SEGMENT
    return out


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text at most; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(arr), 0), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Chunk:
    """The words of a run of texts. ``space``: which bytes part words; ``lower``: fold A-Z first."""

    def __init__(self, arr: pa.Array, space: np.ndarray = SPACE, lower: bool = False):
        self.data, self.offsets = utf8(arr)
        if lower:
            self.data = LOWER[self.data]
        n, off = len(self.data), self.offsets
        gap = space[self.data]
        self.gap = gap
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = gap[:-1]
            after[:-1] = gap[1:]
            before[off[:-1][off[:-1] < n]] = True
            after[off[1:][off[1:] > 0] - 1] = True
        word = ~gap
        #: First byte of each word, byte after its last, and per text the number of its first word (one more entry than texts).
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, off)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, mixed."""
        return span_hashes(self.data, self.starts, self.ends, which)

    def windows(self, hashes: np.ndarray, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all windows of ``length`` words, and whether each lies within one text. Entry i starts at word i."""
        n = len(hashes) - length + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        h = roll(hashes, length, which)
        ok = np.ones(n, bool)
        # a window that starts less than ``length`` words before the next text's first word crosses it
        for edge in np.unique(self.first[1:-1]) if len(self) > 1 else ():
            ok[max(0, edge - length + 1) : edge] = False
        return h, ok


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """The hashes that words of these bytes have."""
    h = spans(lambda lo, hi: _BYTE[which][data[lo:hi]], a, b, which)
    return mix(h + (b - a).astype(U64), which)


def roll(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Rolling polynomial hash of every run of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    step = max(SEGMENT - length, length)
    up, down = powers(which, step + length), powers(which, step, inverse=True)
    out = np.empty(n, U64)
    for lo in range(0, n, step):
        m = min(step, n - lo)
        p = np.zeros(m + length, U64)
        np.cumsum(values[lo : lo + m + length - 1] * up[: m + length - 1], out=p[1:])
        out[lo : lo + m] = mix((p[length:] - p[:m]) * down[:m], 31 * length + which)
    return out


def whole(chunk: Chunk, hashes: np.ndarray, which: int = 0) -> np.ndarray:
    """One hash of each text's whole word sequence; 0 where there is no word."""
    a, b = chunk.first[:-1], chunk.first[1:]
    out = spans(lambda lo, hi: hashes[lo:hi], a, b, which)
    return np.where(b > a, mix(out + (b - a).astype(U64), 5), U64(0))


def cut(arr: pa.Array, most: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text numbers) of runs of about ``most`` bytes. A longer text is cut before a space byte into parts that have
    its number; where it has no space, a part is as long as it must be."""
    data, off = utf8(arr)
    extra: list[int] = []
    for i in np.flatnonzero(np.diff(off) > most):
        at, end = int(off[i]), int(off[i + 1])
        while end - at > most:
            near = np.flatnonzero(SPACE[data[at + 1 : at + most]])
            to = at + 1 + int(near[-1]) if len(near) else end
            for lo in range(at + most, end, most) if not len(near) else ():
                far = np.flatnonzero(SPACE[data[lo : lo + most]])
                if len(far):
                    to = min(end, lo + int(far[0]))
                    break
            if to < end:
                extra.append(to)
            at = to
    edges = np.sort(np.concatenate([off, np.array(extra, np.int64)])) if extra else off
    text = np.minimum(np.searchsorted(off, edges[:-1], side="right") - 1, len(off) - 2)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield data[edges[at] : edges[to]], edges[at : to + 1] - edges[at], text[at:to]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
