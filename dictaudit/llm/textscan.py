"""Vectorised scans over Arrow text columns, shared by the operators of this subpackage.

A text column is handled in slices of a few megabytes (a longer single text makes a slice of its
own), so a Python worker holds a bounded number of bytes whatever the size of an Arrow batch.
Hashes are 64 bits: a polynomial over a fixed random byte table, finished by a mixing function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    """First n powers of the base (or of its inverse) modulo 2**64; grown on demand."""
    have = _powers[kind]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        factors = np.full(size, _BASE if kind == "up" else _BASE_INV)
        factors[0] = 1
        have = _powers[kind] = np.multiply.accumulate(factors)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_slices(col, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    # fill_null gives a fresh array without nulls, so the offsets describe empty texts for them
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of a slice in order: byte range, row and 64-bit hash of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of member bytes; a run never crosses a row's border."""
    if not len(member):
        z = np.zeros(0, np.int64)
        return z, z
    first = member.copy()
    first[1:] &= ~member[:-1]
    at = offsets[:-1]
    at = at[at < len(member)]
    first[at] = member[at]
    last = member.copy()
    last[:-1] &= ~member[1:]
    at = offsets[1:] - 1
    at = at[at >= 0]
    last[at] = member[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash gets the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power_table("up", len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = _power_table("down", len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    start, end = runs(~separator[data], offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, row, range_hash(prefix_hash(data), start, end))


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive elements of h (one fewer than n results are missing)."""
    m = max(len(h) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[i:i + m])
    return out


def same_row(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the n elements from each position on belong to one row."""
    m = max(len(row) - n + 1, 0)
    return row[:m] == row[n - 1:n - 1 + m]


def cover(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """Elements inside any n-window whose start is marked."""
    steps = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def count_by_row(row: np.ndarray, n_rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weight, n_rows).astype(np.int64)
