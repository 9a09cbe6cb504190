"""Vectorised words, word hashes and shingles over Arrow string columns.

A task works on the bytes of many texts at once.  Words are found with one pass
over the byte classes.  A word's 64-bit hash sums a pseudo-random number for each
(place, byte) of it, and a run of words is hashed by doubling, so that no Python
loop runs over words and no regular text makes hashes collide, as it does for
polynomials modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

#: Places of a word whose pseudo-random numbers are kept in a table.
_NEAR = 64
_LEFT, _LENGTH, _SALT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)

#: Bytes that separate words: space and the controls 9 to 13.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters, digits and the bytes of other scripts.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


def _placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each value below 2^22 at its place."""
    return mix(mix((place.astype(U64) << U64(22)) | values.astype(U64)) + _SALT)


_TABLE = _placed(np.tile(np.arange(256), _NEAR), np.repeat(np.arange(_NEAR), 256))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    _, bounds, data = column.buffers()
    if n == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(bounds, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def steps(bounds: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of a single row."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of rows i to j: byte spans, hashes and the first word of each row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, i: int, j: int, blanks=BLANKS, table=None):
        low = int(bounds[i])
        self.data = data[low : int(bounds[j])]
        self.bounds = bounds[i : j + 1] - low
        size = len(self.data)
        inside = ~blanks[self.data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.bounds] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        #: first[r] to first[r + 1]: the words of row r
        self.first = np.searchsorted(self.starts, self.bounds).astype(np.int64)
        self.table = table

    def hashes(self) -> np.ndarray:
        data = self.table[self.data] if self.table is not None else self.data
        return span_hashes(data, self.starts, self.ends)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of the next."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(begin - (end - count), count) + np.arange(total)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span, none of them empty, of bytes or code points: equal spans, equal hashes."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, U64)
    at = ranges(starts, size)
    place = at - np.repeat(starts, size)
    own = values[at]
    if values.dtype == np.uint8:
        near = place < _NEAR
        if near.all():
            value = _TABLE[(place << 8) | own]
        else:
            value = np.empty(len(at), U64)
            value[near] = _TABLE[(place[near] << 8) | own[near]]
            value[~near] = _placed(own[~near], place[~near])
    else:
        value = _placed(own, place)
    return mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(U64) * _LENGTH)


def _doubled(now: np.ndarray, span: int) -> np.ndarray:
    return mix(now[:-span] * _LEFT + now[span:])


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k neighbouring hashes, by doubling."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    span, now = 1, hashes
    while 2 * span <= k:
        now, span = _doubled(now, span), 2 * span
    rest = k - span
    return mix(now[: len(now) - rest] * _LEFT + now[rest:] + U64(k)) if rest else now


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run, none of them empty, of hashes; runs may overlap."""
    size = ends - starts
    out = np.zeros(len(size), dtype=U64)
    longest = int(size.max(initial=0))
    span, now = 1, hashes
    while span <= longest:
        mine = np.flatnonzero((size >= span) & (size < 2 * span))
        out[mine] = mix(now[starts[mine]] * _LEFT + now[ends[mine] - span] + size[mine].astype(U64) * _LENGTH)
        if 2 * span > longest:
            break
        now, span = _doubled(now, span), 2 * span
    return out


_PLACES = seeds(64, 0x51ED) | U64(1)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles and where each row's begin.

    A row with 1 to k - 1 words has one shingle, its whole sequence; one without
    words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=at[1:])
    row = np.repeat(np.arange(len(n)), count)
    where = np.arange(at[-1]) - at[row] + first[row]
    out = np.minimum(n, k)[row].astype(U64) * U64(0xA24BAED4963EE407)
    short = bool((n[n > 0] < k).any())
    last = first[row + 1] if short else None
    for i in range(k):
        here = where + i
        if short:
            ok = here < last
            out[ok] += words[here[ok]] * _PLACES[i]
        else:
            out += words[here] * _PLACES[i]
    return mix(out), at
