"""Vectorised words and Rabin-Karp hashes over the raw bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexloom.llm.common import by_value

U = np.uint64
#: Bytes of text handled at once; the arrays made for them take about thirty times as much.
CHUNK_BYTES = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int, _kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i in 0..n-1."""
    if base not in _kept or len(_kept[base][0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _kept[base] = (pair[0], pair[1])
    return _kept[base][0][:n], _kept[base][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, a null one as empty, and len+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, their bytes, their offsets from 0): whole texts, about `size` bytes of them."""
    data, offsets = raw(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end and row of every word [^\x20\x09-\x0D]+ (no word crosses rows)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_BLANK[data], out=inside[:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each byte span, from one prefix sum."""
    up, down = _powers(_BASES[0], len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every `width` consecutive words of one row, and the number of its first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _powers(_BASES[1], n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=total[1:])
    first = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :])
    return mix((total[first + width] - total[first]) * down[first]), first


def covered(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `first`: the windows merged."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of unsigned integers, lowest byte plane first: near-constant planes compress to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return wide.view("<u8").reshape(n)


by_value(__name__)
