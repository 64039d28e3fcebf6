"""Word positions and hashes of Arrow string columns, computed with numpy inside tasks.

A word is a run of bytes other than space and 0x09-0x0D. Hashes of words of up to LONG_WORD bytes
and of sequences of words are polynomials modulo 2**64, so that any window's hash is a difference
of prefix sums. Such polynomials cannot tell apart certain sequences of 1024 terms and more; longer
words have XXH64 instead, and windows have 50 words at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
CHUNK = 1 << 19
LONG_WORD = 64
#: The powers of each base that were needed so far, up to 2**21 of them.
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; base may be negative for the inverse's powers."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, min(1 << max(16, (n - 1).bit_length()), 1 << 21))
        p = np.full(size, pow(-base, -1, 2**64) if base < 0 else base, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if size > 1 << 21:
            return p[:n]
        _powers[base] = p
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the polynomial's low bits over the whole word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; nulls are empty."""
    column = (column if pa.types.is_string(column.type) else column.cast(pa.string())).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(batch: pa.RecordBatch, text: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, a longer text alone."""
    lengths = np.diff(text_buffer(batch.column(text))[1])
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)


def word_hashes(body: np.ndarray, offsets: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each row's offsets among them.

    With `classes` (a small int for each byte value, 0 for what separates), a word also ends
    where the class changes.
    """
    import xxhash

    kind = (~SPACE).astype(np.uint8) if classes is None else classes
    starts, ends, hashes = [], [], []
    fresh = np.zeros(len(body) + 1, bool)
    fresh[offsets] = True
    at = 0
    while at < len(body):
        end = min(at + CHUNK, len(body))
        while end < len(body):
            till = min(end + CHUNK, len(body))
            gap = np.flatnonzero((kind[body[end:till]] != kind[body[end - 1]]) | fresh[end:till])
            if len(gap):
                end += int(gap[0])
                break
            end = till
        b = body[at:end]
        k = kind[b]
        edge = np.empty(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (k[1:] != k[:-1]) | fresh[at + 1 : end]
        s = np.flatnonzero(edge[:-1] & (k > 0))
        e = np.flatnonzero(edge[1:] & (k > 0)) + 1
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[b] * powers(BYTE_BASE, len(b)), out=sums[1:])
        starts.append(s + at)
        ends.append(e + at)
        found = mixed((sums[e] - sums[s]) * powers(-BYTE_BASE, len(b) + 1)[s]) if len(s) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(e - s > LONG_WORD):
            found[i] = xxhash.xxh64_intdigest(b[s[i] : e[i]])
        hashes.append(found)
        at = end
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets)


def window_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that start at the word positions `at`."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(WORD_BASE, len(hashes)), out=sums[1:])
    return mixed((sums[at + n] - sums[at]) * powers(-WORD_BASE, len(hashes) + 1)[at])


def window_starts(row_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which an n-word window lies within one row, and these rows."""
    count = np.maximum(np.diff(row_offsets) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    return np.arange(len(row)) - first[row] + row_offsets[:-1][row], row
