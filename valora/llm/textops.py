"""Small vectorised helpers on Arrow text columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULT = np.uint64(0x9E3779B97F4A7C15)
#: bytes of text handled at once, so that temporaries stay small
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, row offsets) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def row_groups(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words; a word never crosses a row boundary."""
    mask = _WORD[buf]
    prev = np.empty(len(mask), bool)
    prev[:1] = False
    prev[1:] = mask[:-1]
    cut = off[(off > 0) & (off < len(buf))]
    prev[cut] = False
    starts = np.flatnonzero(mask & ~prev)
    ends_flag = np.zeros(len(mask) + 1, bool)
    ends_flag[1:] = mask & ~np.append(mask[1:], False)
    ends_flag[cut] |= mask[cut - 1]
    return starts, np.flatnonzero(ends_flag)


_POW: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """1, r, r^2, ... modulo 2^64 (kept for the largest word seen)."""
    have = _POW.get(0)
    if have is None or len(have) < n:
        base = np.full(max(n, 256), np.uint64(0x100000001B3))
        base[0] = 1
        with np.errstate(over="ignore"):
            _POW[0] = have = np.cumprod(base)
    return have


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of letters, digits and bytes over
    127, A-Z lower-cased) of all rows, and the word offsets of the rows."""
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    for i, j in row_groups(off):
        part, rel = buf[off[i]: off[j]], off[i: j + 1] - off[i]
        part = _LOWER[part]
        s, e = _word_spans(part, rel)
        if not len(s):
            continue
        size = e - s
        keep = np.repeat(s, size)
        total = int(size.sum())
        first = np.cumsum(size) - size
        inner = np.arange(total) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            v = (part[keep + inner].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[inner]
            h = mix64(np.add.reduceat(v, first) + size.astype(np.uint64) * MULT)
        hashes.append(h)
        counts[i:j] = np.diff(np.searchsorted(s, rel))
    ptr = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ptr[1:])
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), ptr
