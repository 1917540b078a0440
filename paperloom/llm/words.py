"""Vectorised words: lower-cased runs of digits, letters and non-ASCII characters, as 64-bit hashes.

A word is a maximal match of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased.
UTF-8 writes every non-ASCII character with bytes of 128 and more, so the rule holds byte by byte and
whole Arrow buffers are cut and hashed with numpy, without a Python object for each word.

A word's hash is a polynomial over its bytes modulo 2**64, mixed; equal words have equal hashes, and
two different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
PIECE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = True
WORD[128:] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b))]).astype(U), dtype=U) for b in (_BASE, _INVERSE)]
    return _powers


@dataclass
class Words:
    """The words of some texts in order: hash, first byte, and for each text its first word's index (one more at the end)."""

    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def _hashed(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """breaks: bytes at which a text begins; no word runs over one."""
    mask = WORD[data]
    edge = np.empty(len(mask) + 1, dtype=bool)
    edge[0], edge[-1] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    inner = breaks[(breaks > 0) & (breaks < len(mask))]
    inner = np.unique(inner[mask[inner] & mask[inner - 1]])
    at = np.flatnonzero(edge)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]))
    start, end = at[::2], at[1::2]
    power, inverse = _tables(len(data))
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum((LOWER[data].astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * inverse[start])
    h[h == 0] = 1
    return h, start, end - start


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; memory beside the result is bounded by PIECE and the longest word."""
    base, end = int(offsets[0]), int(offsets[-1])
    parts, at = [], base
    while at < end:
        stop = min(end, at + PIECE)
        while stop < end and WORD[data[stop]] and WORD[data[stop - 1]]:
            near = np.flatnonzero(~WORD[data[stop : stop + 4096]])
            stop = stop + int(near[0]) if len(near) else min(end, stop + 4096)
        breaks = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "left")] - at
        h, start, length = _hashed(data[at:stop], breaks)
        parts.append((h, start + at, length))
        at = stop
    h, start, length = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype) for k, dtype in enumerate((U, np.int64, np.int64)))
    return Words(h, start, length, np.searchsorted(start, offsets, "left"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without a copy; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset, data = column.buffers()
    offsets = np.frombuffer(offset, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 * PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with at most so many bytes of text, or one text, and the text's bytes and offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            j = min(j, n, i + 4096)
            yield batch.slice(i, j - i), data, offsets[i : j + 1]
            i = j


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 entries take what words there are."""
    out = mix(h + U(n))
    for k in range(1, n):
        out[:-k or None] += mix(h[k:] ^ U(0xD6E8FEB86659FD93 * (k + 1) % 2**64))
    return mix(out)
