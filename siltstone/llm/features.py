"""Hashed word n-grams of a batch of texts, as indices below a power of two."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siltstone.llm.wordhash import LOWER, NOT_ALNUM, U64, Words, mix, seeds, span_hashes, steps, utf8

_KIND = seeds(8, 21) | U64(1)


def _joined(words: np.ndarray, row: np.ndarray, gap: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words ``gap`` apart in one row."""
    if len(words) <= gap:
        return row[:0], words[:0]
    ok = row[gap:] == row[:-gap]
    pair = mix(words[:-gap] * _KIND[kind] + words[gap:] * _KIND[kind + 1])
    return row[:-gap][ok], pair[ok]


def hashed_grams(column: pa.Array, bits: int, skips: bool, stems: tuple[int, ...] = ()):
    """Yields (i, j, row, index) for row ranges: each word, pair and, with ``skips``, pair one apart.

    ``stems`` adds the first so many bytes of each longer word.  ``row`` counts from
    i and isn't sorted; words are lower-cased runs of letters and digits.
    """
    data, bounds = utf8(column)
    shift = U64(64 - bits)
    for i, j in steps(bounds):
        found = Words(data, bounds, i, j, blanks=NOT_ALNUM, table=LOWER)
        words = found.hashes()
        row = np.repeat(np.arange(j - i), np.diff(found.first))
        parts = [(row, words), _joined(words, row, 1, 0)]
        if skips:
            parts.append(_joined(words, row, 2, 2))
        for n in stems:
            long = np.flatnonzero(found.ends - found.starts > n)
            parts.append((row[long], mix(span_hashes(LOWER[found.data], found.starts[long], found.starts[long] + n) * _KIND[5])))
        yield i, j, np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) >> shift).astype(np.int64)
