"""Word boundaries and word hashes of whole Arrow text columns, in numpy.

A word is a maximal run of ASCII letters, digits, underscores and bytes above
0x7f, so every accented letter is a word character; ASCII letters are folded
to lower case here, other letters are lowered by ``text_chunks(lower=True)``.
Scripts that are written without spaces (Chinese, Japanese, Thai, Lao) have a
word per character. No Python string is made: the Arrow buffers are read in
place, and a long row is hashed a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array, most_bytes: int = 1 << 19, most_rows: int = 1 << 18, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into bytes) of consecutive rows.

    A chunk holds at most ``most_rows`` whole rows of at most ``most_bytes``
    bytes together, or one longer row; what is worked out for it stays small
    however large the column. Null rows count as empty. ``lower``: letters of
    all scripts are lowered, chunk by chunk.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets, raw = _buffers(column)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        end = min(max(end, first + 1), first + most_rows, n)
        if lower:
            at, data = _buffers(pc.utf8_lower(column.slice(first, end - first)))
        else:
            at, data = offsets[first : end + 1], raw
        yield first, end, data[at[0] : at[-1]], at - at[0]
        first = end


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array, without copying."""
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, count=column.offset + len(column) + 1)[column.offset :]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class WordHasher:
    """Hashes words of byte buffers; one per task, as it keeps tables of powers.

    ``by_space``: words are the runs between white space instead, as written.
    """

    PIECE = 1 << 19

    def __init__(self, by_space: bool = False) -> None:
        codes = np.arange(256)
        self.is_word = (codes >= 128) | ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)) | (codes == 95)
        self.fold = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64) + np.uint64(1)
        if by_space:
            self.is_word, self.fold = ~np.isin(codes, [9, 10, 11, 12, 13, 32]), codes.astype(np.uint64) + np.uint64(1)
        self.by_space = by_space
        up, down = np.full(self.PIECE + 1, _MULT, np.uint64), np.full(self.PIECE + 1, pow(_MULT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def _single(self, data: np.ndarray, edge: np.ndarray) -> None:
        """Mark both ends of each character (of three bytes) of scripts without spaces."""
        lead = np.flatnonzero((data >= 0xE0) & (data <= 0xE9))
        if not len(lead):
            return
        after = data[np.minimum(lead + 1, len(data) - 1)]
        lead = lead[(data[lead] >= 0xE3) | ((data[lead] == 0xE0) & (after >= 0xB8) & (after <= 0xBB))]
        edge[lead] = True
        edge[np.minimum(lead + 3, len(data))] = True

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, end byte) of each word, and each row's first word (rows + 1 entries)."""
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = self.is_word[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if not self.by_space:
            self._single(data, edge)
        starts = np.flatnonzero((inside[1:] & (~inside[:-1] | edge))[:n])
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        hashes, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + self.PIECE, "right")))
            hashes[i:j] = self._hashes(data, starts[i:j], ends[i:j])
            i = j
        return hashes, starts, ends, np.searchsorted(starts, offsets)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        base, n = int(starts[0]), int(ends[-1] - starts[0])
        with np.errstate(over="ignore"):
            if n > self.PIECE:  # one word of more than a piece
                total, scale = np.uint64(0), np.uint64(1)
                for at in range(base, base + n, self.PIECE):
                    part = self.fold[data[at : min(at + self.PIECE, base + n)]]
                    total += scale * np.sum(part * self.down[: len(part)], dtype=np.uint64)
                    scale *= self.down[self.PIECE]
                sums = np.array([total], np.uint64)
            else:
                run = np.zeros(n + 1, np.uint64)
                np.cumsum(self.fold[data[base : base + n]] * self.down[:n], out=run[1:])
                sums = (run[ends - base] - run[starts - base]) * self.up[starts - base]
            return mix64(sums + (ends - starts).astype(np.uint64))
