"""Texts of an Arrow batch as byte buffers, and their words as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes worked on at once; bounds the temporaries, never the text
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets into them); a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(texts: pa.Array, most: int = 4 * SEGMENT):
    """(start, stop) runs of rows of about `most` bytes; a longer text is a run of its own."""
    if not len(texts):
        return
    _, offsets = utf8(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word in order: runs of bytes outside `gap` (space and 0x09-0x0D), A-Z in lower case."""
    hashes, rows, at = [], [], 0
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        if end < len(raw):  # cut where no word runs on: before white space, or where a text begins
            cut = np.flatnonzero(gap[raw[at:end]])
            inside = offsets[(offsets > at) & (offsets <= end)]
            end = max(at + int(cut[-1]) if len(cut) else 0, int(inside[-1]) if len(inside) else 0)
            if end <= at:  # one word longer than a segment
                more = np.flatnonzero(gap[raw[at + 1 :]])
                nxt = offsets[offsets > at]
                end = min(at + 1 + int(more[0]) if len(more) else len(raw), int(nxt[0]))
        part = raw[at:end]
        word = ~gap[part]
        fresh = np.ones(len(part), bool)
        fresh[1:] = ~word[:-1]
        begins = offsets[(offsets >= at) & (offsets < end)] - at
        fresh[begins] = True
        start = np.flatnonzero(word & fresh)
        if len(start):
            stop_mark = np.ones(len(part), bool)
            stop_mark[:-1] = ~word[1:]
            stop_mark[begins[begins > 0] - 1] = True
            stop = np.flatnonzero(word & stop_mark) + 1
            up, down = powers(_BASE, len(part) + 1), powers(inverse(_BASE), len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            hashes.append(mixed((sums[stop] - sums[start]) * down[start]))
            rows.append(np.searchsorted(offsets, start + at, "right") - 1)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def segments(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray, most: int = SEGMENT):
    """(start, stop) of stretches of about `most` bytes that end before a gap byte or where a text ends, so that no word is cut.

    A word longer than that makes its stretch longer.
    """
    at = 0
    while at < len(raw):
        end = min(at + most, len(raw))
        if end < len(raw):
            cut = np.flatnonzero(gap[raw[at:end]])
            inside = offsets[(offsets > at) & (offsets <= end)]
            end = max(at + int(cut[-1]) if len(cut) else 0, int(inside[-1]) if len(inside) else 0)
            while end <= at:  # the word goes on: look further, step by step
                far = min(at + most, len(raw))
                more = np.flatnonzero(gap[raw[at + 1 : far + 1]])
                nxt = offsets[offsets > at]
                if len(more) or far == len(raw) or nxt[0] <= far:
                    end = min(at + 1 + int(more[0]) if len(more) else len(raw), int(nxt[0]))
                most *= 2
        yield at, end
        at = end


def strings(part: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The stretches start[i]:stop[i], in order and apart, as an array of strings."""
    edge = np.zeros(len(part) + 1, np.int8)
    edge[start] = 1
    edge[stop] -= 1
    raw = np.ascontiguousarray(part[np.cumsum(edge[:-1], dtype=np.int8) > 0])
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def rows_of(counts: np.ndarray) -> np.ndarray:
    """0 counts[0] times, 1 counts[1] times and so on."""
    return np.repeat(np.arange(len(counts)), counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of the given lengths over the values in order."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Packed little-endian values: one binary of counts[i] values per row."""
    raw = np.ascontiguousarray(data)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * raw.dtype.itemsize
    whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return whole.cast(pa.binary())


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of binaries: (values of all rows, number of values of each row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    size = np.dtype(dtype).itemsize
    if raw.ctypes.data % size:
        raw = raw.copy()
    return raw.view(dtype), np.diff(offsets) // size
