"""Vectorised text kernels: words, spans and n-grams as 64-bit hashes, straight from Arrow buffers.

A word is a maximal run of [0-9a-z_] and non-ASCII characters of the lower-cased
text; U+0080-00BF, U+2000-206F and U+3000-303F (punctuation and blanks) separate.
As a regular expression over lower(text): WORD_RE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[^\x00-\x2F\x3A-\x5E\x60\x7B-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]+"

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_PRIME = 4_294_967_291  # the largest below 2**32
_LONG = 512  # bytes from which a span's hash also takes its residue
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[95] = True
_IS_WORD[128:] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _BLOCK + 4096)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty string."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def span_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; it depends on nothing but them.

    near: ascending anchors (one for each row of spans) that say which spans are
    worked on together; by default the spans themselves, which then must ascend.

    It is a polynomial modulo 2**64; a span of 512 bytes or more adds one modulo a
    prime, since strings that cancel modulo powers of two (they need 1024 bytes) don't
    there. Two of n different strings share a hash with a chance of n**2 / 2**65.
    """
    out = np.empty(first.shape, np.uint64)
    anchor = first if near is None else near
    at, n = 0, len(anchor)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(anchor, anchor[at] + _BLOCK)))
        a, b = first[at:stop], end[at:stop]
        if not a.size:
            at = stop
            continue
        low = int(a.min())
        high = max(int(b.max()), low)
        up, down = _tables(high - low + 1)
        c = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=c[1:])
        h = (c[b - low] - c[a - low]) * down[a - low]
        if (long := b - a >= _LONG).any():
            h[long] += mix(_residues(raw, a[long], b[long]))
        out[at:stop] = h
        at = stop
    return mix(out + (end - first).astype(np.uint64))


def _residues(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomials of spans modulo the prime, by Horner's rule in pieces of 512 bytes."""
    powers = np.ones(_LONG + 1, np.uint64)
    for i in range(1, _LONG + 1):
        powers[i] = powers[i - 1] * np.uint64(0x9E3779B1) % np.uint64(_PRIME)
    out = np.zeros(len(first), np.uint64)
    for i, (a, z) in enumerate(zip(first.tolist(), end.tolist())):
        size = -(-(z - a) // _LONG)
        padded = np.zeros(size * _LONG, np.uint64)
        padded[: z - a] = raw[a:z]
        h = 0
        # 512 products below 2**40 add up below 2**49
        for x in (padded.reshape(size, _LONG) * powers[:_LONG]).sum(1, dtype=np.uint64).tolist():
            h = (h * int(powers[_LONG]) + x) % _PRIME
        out[i] = h
    return out


def _word_mask(raw: np.ndarray) -> np.ndarray:
    is_word = _IS_WORD[raw]
    if raw.size and raw.max() >= 0xC2:
        lead = np.flatnonzero(raw == 0xC2)
        is_word[lead] = False
        is_word[lead + 1] = False
        for b0, b1s, low, high in ((0xE2, (0x80,), 0x80, 0xBF), (0xE2, (0x81,), 0x80, 0xAF), (0xE3, (0x80,), 0x80, 0xBF)):
            lead = np.flatnonzero(raw == b0)
            if lead.size:
                third = raw[lead + 2]
                lead = lead[np.isin(raw[lead + 1], b1s) & (third >= low) & (third <= high)]
                for k in range(3):
                    is_word[lead + k] = False
    return is_word


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of True that don't cross the offsets."""
    n = len(mask)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cut = off[(off > 0) & (off < n)]
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the lower-cased text, first, end, ptr): ptr[i]:ptr[i+1] are the words of text i."""
    raw, off = utf8(pc.utf8_lower(arr))
    first, end = runs(_word_mask(raw), off)
    return raw, first, end, np.searchsorted(first, off)


def word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, ptr)."""
    raw, first, end, ptr = word_spans(arr)
    return span_hashes(raw, first, end), ptr


def gram_hashes(words: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every text with ptr of its own; a text of fewer words has one gram of them all, one of none has none."""
    sizes = np.diff(ptr)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_ptr = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(ptr[:-1] - out_ptr[:-1], count) + np.arange(out_ptr[-1])
    left = np.repeat(ptr[1:], count) - at
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        take = at + k
        inside = left > k
        w = words[np.where(inside, take, 0)] if len(words) else np.zeros(0, np.uint64)
        h = h * np.uint64(0xD1342543DE82EF95) + np.where(inside, w, np.uint64(k + 1))
    return mix(h), out_ptr


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has about `most` bytes of the column; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(a), int(b - a))
