"""Arrow strings as flat numpy code-point arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of UTF-8 that one vectorised step takes at most, beyond a single row.
SLICE_BYTES = 1 << 20


def _offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(1, np.int64), memoryview(b"")
    offs = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = memoryview(data)[offs[0] : offs[-1]] if data is not None else memoryview(b"")
    return offs - offs[0], raw


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and the n + 1 row offsets into it. Null rows are empty."""
    offs, raw = _offsets_and_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    try:
        flat = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        starts = np.concatenate(([0], np.cumsum(lead)))[offs]
    except UnicodeDecodeError:  # invalid bytes from elsewhere: row by row, so that none leaks into the next
        rows = [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        flat = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return flat, starts


def to_strings(flat: np.ndarray, starts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The reverse of :func:`to_codepoints`; rows where ``valid`` is false become null."""
    data = flat.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
    offs = np.concatenate(([0], np.cumsum(width)))[starts].astype(np.int32)
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(starts) - 1, [mask, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])


def validity(column: pa.Array) -> np.ndarray:
    return np.asarray(column.is_valid())


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take about ``most`` bytes, so that memory doesn't follow the longest batch."""
    offs, _ = _offsets_and_bytes(column)
    begin, n = 0, len(column)
    while begin < n:
        end = int(np.searchsorted(offs, offs[begin] + most, "right")) - 1
        end = min(n, max(begin + 1, end))
        yield begin, end
        begin = end


def row_of(starts: np.ndarray) -> np.ndarray:
    """For each code point the row it stands in."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def segment_hash(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each segment [begin, end) of the array; segments must not overlap and be in order."""
    if len(begins) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        lens = ends - begins
        total = int(lens.sum())
        out = np.concatenate(([0], np.cumsum(lens)))
        within = np.arange(total) - np.repeat(out[:-1], lens)
        value = mix(flat[np.repeat(begins, lens) + within].astype(np.uint64) + np.uint64(seed))
        value *= mix(within.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) | np.uint64(1)
        sums = np.add.reduceat(np.concatenate((value, np.zeros(1, np.uint64))), np.minimum(out[:-1], total))
        sums[lens == 0] = 0
        return mix(sums + lens.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
