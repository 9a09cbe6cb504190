"""Texts of word runs, cut from a batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siltstone.llm.wordhash import Words, ranges


def spelled(words: Words, begin: np.ndarray, count: np.ndarray) -> pa.Array:
    """``count`` words, at least one, from each ``begin`` on, joined by one space; bytes as in the words' table."""
    at = ranges(begin, count)
    size = words.ends[at] - words.starts[at]
    to = np.cumsum(size + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
    own = words.data[ranges(words.starts[at], size)]
    out[ranges(to - size - 1, size)] = own if words.table is None else words.table[own]
    last = to[np.cumsum(count) - 1] - 1 if len(count) else to
    bounds = np.concatenate(([0], last - np.arange(len(last)))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(last), [None, pa.py_buffer(bounds), pa.py_buffer(np.delete(out, last))])
