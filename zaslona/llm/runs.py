"""Hashes of all tokens of many texts at once, without a Python step per token.

A token is a longest run of bytes of one class. With c the prefix sums of byte * M**position (mod 2**64), the run from
a to b has the hash (c[b] - c[a]) * M**-a, mixed at the end: the same for the same bytes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15
_W = pow(_M, -1, 1 << 64)
#: Bytes hashed at once, but for longer tokens. Longer texts are cut at white space.
BLOCK = 1 << 20
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        m = max(n, BLOCK + 4096)
        up, down = np.full(m, _M, np.uint64), np.full(m, _W, np.uint64)
        up[0] = down[0] = 1
        _tables[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _tables[0], _tables[1]


def classes(**sets: bytes) -> np.ndarray:
    """A class for each byte: 0 (between tokens) or the place of the argument that names it, from 1."""
    out = np.zeros(256, np.uint8)
    for i, chars in enumerate(sets.values(), 1):
        out[list(chars)] = i
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the tokens of a buffer."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = kind[buf]
    change = np.flatnonzero(k[1:] != k[:-1]) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [n]])
    keep = k[starts] > 0
    starts, ends = starts[keep], ends[keep]
    up, down = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=c[1:])
    return starts, ends, mixed((c[ends] - c[starts]) * down[starts])


def _cuts(text: bytes) -> list[bytes]:
    """A long text in parts of about a block, cut before white space only; what has none stays whole."""
    out, i = [], 0
    while len(text) - i > BLOCK:
        at = max(text.rfind(b" ", i, i + BLOCK), text.rfind(b"\n", i, i + BLOCK))
        if at <= i:
            at = min((x for x in (text.find(b" ", i + BLOCK), text.find(b"\n", i + BLOCK)) if x > 0), default=len(text))
        out.append(text[i:at])
        i = at
    return [*out, text[i:]]


def hashes(texts: list[bytes], kind: np.ndarray) -> list[np.ndarray]:
    """For each text the hashes of its tokens."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            starts, _, h = runs(np.frombuffer(b"\n".join(held), np.uint8), kind)
            offsets = np.cumsum([len(t) + 1 for t in held])
            out.extend(np.split(h, np.searchsorted(starts, offsets[:-1])))
        held, size = [], 0

    for t in texts:
        if len(t) > BLOCK:
            flush()
            out.append(np.concatenate([runs(np.frombuffer(x, np.uint8), kind)[2] for x in _cuts(t)]))
            continue
        if size + len(t) > BLOCK:
            flush()
        held.append(t)
        size += len(t) + 1
    flush()
    return out
