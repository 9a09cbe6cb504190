"""CRC-32 of many byte spans at once, and of runs of words joined by one byte.

The register is linear in the message: each byte adds a number that depends on it
and on how many bytes follow, and a finished part is carried past n further bytes
by a fixed linear map.  So spans are sums (exclusive or) of table entries, and a run
of words is put together from its words without reading their bytes again.
"""

from __future__ import annotations

import numpy as np

from siltstone.llm.wordhash import ranges

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_NEAR = 64
_U32 = np.uint32


def _byte_table() -> np.ndarray:
    v = np.arange(256, dtype=_U32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ _U32(POLYNOMIAL), v >> 1).astype(_U32)
    return v


_BYTE = _byte_table()


def _past_one(x: np.ndarray) -> np.ndarray:
    return (x >> _U32(8)) ^ _BYTE[x & _U32(255)]


def _places() -> np.ndarray:
    """What each byte adds with 0, 1, ... bytes after it."""
    out = [_BYTE]
    while len(out) < _NEAR:
        out.append(_past_one(out[-1]))
    return np.stack(out)


#: values of each of the register's four bytes
_UNITS = (np.arange(256, dtype=_U32)[None, :] << (np.arange(4, dtype=_U32) * _U32(8))[:, None]).astype(_U32)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its values of each byte, of registers."""
    return table[0][x & _U32(255)] ^ table[1][(x >> _U32(8)) & _U32(255)] ^ table[2][(x >> _U32(16)) & _U32(255)] ^ table[3][x >> _U32(24)]


def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps past 0 to 63 bytes, and those past 64, 128, ... bytes."""
    near = [_UNITS]
    while len(near) < _NEAR:
        near.append(_past_one(near[-1]))
    far = [_past_one(near[-1])]
    while len(far) < 26:
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), far


_PLACE = _places()
_NEAR_MAPS, _FAR_MAPS = _maps()


def past(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n further zero bytes."""
    m = (n & (_NEAR - 1)).astype(np.int64) * 1024
    flat = _NEAR_MAPS.ravel()
    out = flat[m + (x & _U32(255))] ^ flat[m + 256 + ((x >> _U32(8)) & _U32(255))] ^ flat[m + 512 + ((x >> _U32(16)) & _U32(255))] ^ flat[m + 768 + (x >> _U32(24))]
    rest = n // _NEAR
    for j, table in enumerate(_FAR_MAPS):
        if not rest.any():
            break
        some = np.flatnonzero(rest & 1)
        out[some] = _apply(table, out[some])
        rest = rest >> 1
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The linear register of each span, none of them empty."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, _U32)
    at = ranges(starts, size)
    after = np.repeat(ends, size) - 1 - at
    own = data[at]
    near = after < _NEAR
    if near.all():
        value = _PLACE.ravel()[(after << 8) | own]
    else:
        value = np.empty(len(at), _U32)
        value[near] = _PLACE.ravel()[(after[near] << 8) | own[near]]
        value[~near] = past(_BYTE[own[~near]], after[~near])
    return np.bitwise_xor.reduceat(value, np.cumsum(size) - size)


def finished(register: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of messages from their registers and sizes."""
    top = int(size.max(initial=0))
    if top < 1 << 16:
        begin = past(np.full(top + 1, 0xFFFFFFFF, dtype=_U32), np.arange(top + 1))[size]
    else:
        begin = past(np.full(len(size), 0xFFFFFFFF, dtype=_U32), size)
    return register ^ begin ^ _U32(0xFFFFFFFF)


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int, joint: int = 32):
    """Yields (k, CRC-32 of each k neighbouring words joined by the byte ``joint``), for k from 1 to ``most``.

    Runs may cross from one text to the next; the caller leaves those out.
    """
    size = ends - starts
    word = registers(data, starts, ends)
    led = past(np.full(len(size), _BYTE[joint], dtype=_U32), size) ^ word
    run, total = word, size
    for k in range(1, most + 1):
        if k > 1:
            n = max(0, len(size) - k + 1)
            run, total = past(run[:n], size[k - 1 :] + 1) ^ led[k - 1 :], total[:n] + size[k - 1 :] + 1
        yield k, finished(run, total)
