"""Language-model scoring by online logistic context mixing, and a smoothed unigram base.

A text is a string of lower-cased bytes and an end mark, cut into units: a word with the white space byte after it, or
such a byte alone. A unit is coded as bits in two steps.

* The path: a prefix code of the most frequent units and an escape, from their counts. For each bit two predictors
  tell what training texts did at this node of the code: in any context, and after the last of the very commonest units
  (which tells the language and the construction). Each gives a logit; the logits are added with weights from a set
  that a gate chooses, by how often the context was seen at the node and how deep it is. The weights come from a
  Newton step over all training units, each without its own count.
* The spelling of what is not frequent, in the same way over the bits of a fixed prefix code of bytes, with the last 2,
  3 and 5 bytes of the unit and all of it so far as hashed contexts.

While a text is read the mixture is refined online: the mixed path and each predictor's own path are experts whose
logistic weights take a step down the gradient of the coding cost after every block of the text's units.

A memory of all training phrases is mixed in last. A phrase ends where a unit's hash says so, so equal passages have
equal phrases wherever they stand; it may also be drawn from those that other training texts hold, by their counts in
a shuffled table. A few shares of such phrases each predict the text; by Bayes' rule the text shifts the mixture to
those that code it with fewer bits. All experts are distributions, so the probabilities of all texts sum to at most one.

All counts cover all training documents. Path and spelling have tables of bounded size, so that a task can hold them;
counts of words and phrases are shuffled tables that grow with the input.

Defined results: a null text counts as empty, that is, the end mark alone; repeated rows each get a row and each count
as training; rows with a null id count as training. Without training documents all counts are zero.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, sliced
from .runs import _powers, mixed

#: Slots of each spelling predictor's table, at most; powers of two.
SLOTS = (1 << 17, 1 << 20, 1 << 21, 1 << 22)
ORDERS = (2, 3, 5, 0)  # bytes of context; 0: the unit so far
GATES = 12
#: Words whose counts are carried to the texts; all others are joined.
FREQUENT = 50_000
#: Units that the path codes, and the commonest of them that serve as a context.
PATHS, COMMONEST = 32_768, 64
PATH_GATES, EXPERTS = 12, 3
#: Units between two steps of a text's weights, the step, and the bytes of texts that are taken together.
BLOCK, RATE, TOGETHER = 64, 0.02, 1 << 19
#: Spelled units whose costs are worked out once and sent to all tasks, at most (24 bytes each); the rest are worked out where they are met.
SENT = 1_000_000
#: One unit in so many ends a phrase; shares of remembered phrases.
PHRASE = 24
SHARES = (0.001, 0.05, 0.5, 0.95)
_SEGMENTS, _SALTS = 64, 16
_END = 256
_FLUSH = 200_000  # distinct units a task holds before it passes their counts on
_LONG = 63  # bytes of a unit that are coded together
_AT_ONCE = 2048
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_W1 = np.uint32(pow(0x9E3779B1, -1, 1 << 32))
_WHITE = b" \t\n\r\x0b\x0c"
_UNIT = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]?|[\x20\x09-\x0D]")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Code:
    """A prefix code of symbols by their weights: for each the nodes on its path and the bit taken there."""

    def __init__(self, weight: list[float]):
        n = first = len(weight)
        heap = [(w, s, s) for s, w in enumerate(weight)]
        heapq.heapify(heap)
        kids = {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids[n] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        paths: dict[int, tuple] = {heap[0][2]: ()}
        for node in sorted(kids, reverse=True):
            for bit, kid in enumerate(kids[node]):
                paths[kid] = (*paths[node], (node - first, bit))
        self.length = np.array([len(paths[s]) for s in range(first)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        flat = [x for s in range(first) for x in paths[s]]
        self.node, self.bit = np.array([x[0] for x in flat], np.uint32), np.array([x[1] for x in flat], bool)

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For symbols in turn: whose each bit is, and where it stands in node and bit."""
        length = self.length[symbols]
        owner = np.repeat(np.arange(len(symbols)), length)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length - self.start[symbols], length)


def byte_weights() -> list[float]:
    """Of the 256 bytes and the end mark: a rough picture of prose in UTF-8."""
    weight = [1.0] * 256 + [2.0]
    for i, c in enumerate(b" etaonirshldu"):  # commonest signs first
        weight[c] = 4000.0 / (i + 1)
    for c in b"cmfpgwybvkxjqz":
        weight[c] = 150.0
    for c in b"\n.,":
        weight[c] = 120.0
    for c in range(0x80, 0xC0):
        weight[c] = 12.0
    weight[0xC3] = 400.0
    return weight


_code: list[Code] = []


def code() -> Code:
    if not _code:
        _code.append(Code(byte_weights()))
    return _code[0]


def units(raw: bytes) -> list[bytes]:
    """A text's units; the last has no white space after it (it may be empty), which stands for the end mark."""
    out = _UNIT.findall(raw)
    return out if out and out[-1][-1:] not in _WHITE_BYTES else [*out, b""]


_WHITE_BYTES = {bytes([b]) for b in _WHITE}


def slots_for(n_units: int) -> tuple[int, ...]:
    """The slots of the spelling predictors' tables for so many training units."""
    return tuple(min(m, 1 << max(10, n_units.bit_length() + 1)) for m in SLOTS)


def bits(some: list[bytes], sizes: tuple[int, ...] = SLOTS) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For units: the number of each bit's unit, the bit, its slot for each predictor, the length of the context."""
    c = code()
    parts, owner_of = [], []
    for i, u in enumerate(some):
        if len(u) > _LONG:
            cut = [u[j : j + _LONG] for j in range(0, len(u), _LONG)]
            parts += cut
            owner_of += [i] * len(cut)
        else:
            parts.append(u)
            owner_of.append(i)
    # The end mark follows the last part of a unit without white space.
    last = np.array([j + 1 == len(parts) or owner_of[j + 1] != owner_of[j] for j in range(len(parts))])
    ends = last & np.array([p[-1:] not in _WHITE_BYTES for p in parts])
    size = np.array([len(p) for p in parts]) + ends
    n = int(size.sum())
    start = np.cumsum(size) - size
    part = np.repeat(np.arange(len(parts)), size)
    at = np.arange(n) - start[part]
    symbols = np.full(n, _END, np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    is_end = np.zeros(n, bool)
    is_end[(start + size - 1)[ends]] = True
    symbols[~is_end] = raw
    value = symbols.astype(np.uint32) + np.uint32(1)
    value[is_end] = 0
    h, by_order = np.zeros(n, np.uint32), {}
    for k in range(1, 6):
        before = np.zeros(n, np.uint32)
        before[k:] = value[:-k] if k < n else 0
        before[at < k] = 0
        h = (h + before) * _M1 + np.uint32(k)
        by_order[k] = h
    up = np.full(n + 1, _M1, np.uint32)
    down = np.full(n + 1, _W1, np.uint32)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint32), np.cumprod(down, dtype=np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(value * up[:n], dtype=np.uint32)])
    first = start[part]
    by_order[0] = (sums[np.arange(n)] - sums[first]) * down[first] + at.astype(np.uint32)
    owner, place = c.bits(symbols)
    node = ((c.node + np.uint32(1)) * _M2) >> np.uint32(7)
    slots = []
    for k, m in zip(ORDERS, sizes):
        x = by_order[k] * _M2
        x = ((x ^ (x >> np.uint32(15))) & np.uint32(m - 1)).astype(np.int64)
        slots.append(x[owner] ^ (node & np.uint32(m - 1)).astype(np.int64)[place])
    return np.array(owner_of)[part][owner], c.bit[place], slots, at[owner]


def seen(n: np.ndarray) -> np.ndarray:
    return ((n > 0).astype(np.uint8) + (n > 3) + (n > 30)).astype(np.uint8)


def gates(seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The set of weights: by the class of how often the longest context was seen, and by its length."""
    return seen.astype(np.int64) * 3 + (at > 1) + (at > 4)


class Model:
    """Logits of all slots, how often the longest context was seen, and the weights."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = [t.astype(np.float32) for t in tables]  # for the weights only
        self.sizes = tuple(t.shape[1] for t in tables)
        self.logits = [(np.log((t[1] + 0.4) / (t[0] + 0.4))).astype(np.float32) for t in tables]
        self.seen = seen(tables[-1].sum(axis=0))
        self.weights = np.full((GATES, len(tables)), 0.25, np.float32)

    def inputs(self, some: list[bytes]):
        unit, bit, slots, at = bits(some, self.sizes)
        return unit, bit, [t[s] for t, s in zip(self.logits, slots)], gates(self.seen[slots[-1]], at)

    def inputs_without(self, some: list[bytes]):
        """As if each unit had been counted once less, as for a text that was not learnt."""
        unit, bit, slots, at = bits(some, self.sizes)
        one, zero = bit.astype(np.float32), (~bit).astype(np.float32)
        n = [(np.maximum(t[0][s] - zero, 0), np.maximum(t[1][s] - one, 0)) for t, s in zip(self.tables, slots)]
        return unit, bit, [np.log((b + 0.4) / (a + 0.4)) for a, b in n], gates(seen(n[-1][0] + n[-1][1]), at)

    def _sum(self, x, g) -> np.ndarray:
        w = self.weights.T
        z = x[0] * w[0][g]
        for j in range(1, len(x)):
            z += x[j] * w[j][g]
        return z

    def costs(self, some: list[bytes]) -> np.ndarray:
        """The nats of each unit."""
        unit, bit, x, g = self.inputs(some)
        z = self._sum(x, g)
        z = np.clip(np.where(bit, -z, z), -24, 24)  # single precision carries a cost of 1e-7 nats
        return np.bincount(unit, np.log(np.float32(1) + np.exp(z)), len(some))

    def slope(self, some: list[bytes], count: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the cost by the weights, for units that stand ``count`` times: (gates, j, j + 1)."""
        unit, bit, x, g = self.inputs_without(some)
        p = 1 / (1 + np.exp(-np.clip(self._sum(x, g), -30, 30)))
        return slopes(x, g, p, bit, count[unit].astype(np.float32), GATES)

    def step(self, slope: np.ndarray) -> None:
        stepped(self.weights, slope)


def slopes(x: list[np.ndarray], g: np.ndarray, p: np.ndarray, bit: np.ndarray, count, gates: int) -> np.ndarray:
    """Gradient and curvature of the cost by the weights of each gate: (gates, j, j + 1)."""
    order = np.argsort(g.astype(np.uint8), kind="stable")
    ends = np.searchsorted(g[order], np.arange(gates + 1))
    first, second = ((p - bit) * count)[order], (p * (1 - p) * count)[order]
    rows = np.stack(x, axis=1)[order]
    j = len(x)
    out = np.zeros((gates, j, j + 1))
    for k in range(gates):
        of = slice(ends[k], ends[k + 1])
        out[k, :, :j] = (rows[of] * second[of, None]).T @ rows[of]
        out[k, :, j] = rows[of].T @ first[of]
    return out


def stepped(weights: np.ndarray, slope: np.ndarray) -> None:
    """Moves the weights down the cost by a Newton step of bounded length."""
    j = weights.shape[1]
    for g in range(len(weights)):
        ridge = np.eye(j) * (1.0 + 1e-3 * np.trace(slope[g, :, :j]) / j)
        move = np.linalg.solve(slope[g, :, :j] + ridge, slope[g, :, j])
        weights[g] -= np.clip(move, -0.5, 0.5).astype(np.float32)


def pieces(raws: list[bytes]):
    """Texts in groups (list of (number, bytes, whether the text ends)) of about ``TOGETHER`` bytes; a longer text is cut behind white space."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        begin = 0
        while True:
            end = len(raw)
            if end - begin > TOGETHER:
                m = _SPACE.search(raw, begin + TOGETHER - 1)
                end = m.end() if m else end
            if held and size + end - begin > TOGETHER:
                yield held
                held, size = [], 0
            held.append((i, raw[begin:end], end == len(raw)))
            size += end - begin
            if end == len(raw):
                break
            begin = end
    if held:
        yield held


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(_WHITE)] = True


class Cut:
    """The units of a group: starts, ends, hashes, the piece of each, and which are a text's last."""

    def __init__(self, group: list[tuple[int, bytes, bool]]):
        self.raw = b"".join(x[1] for x in group)
        buf = np.frombuffer(self.raw, np.uint8)
        stop = np.cumsum([len(x[1]) for x in group])
        closes = stop[np.array([x[2] for x in group], bool)]
        # A text's last unit, which may be empty, comes after the one that ends in white space there.
        order = np.sort(np.concatenate([(np.flatnonzero(_IS_WHITE[buf]) + 1) * 2, closes * 2 + 1]), kind="stable")
        self.end, self.last = order >> 1, (order & 1).astype(bool)
        self.start = np.concatenate([[0], self.end[:-1]])
        up, down = _powers(len(buf) + 1)
        c = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=c[1:])
        self.hash = mixed((c[self.end] - c[self.start]) * down[self.start])
        # Units of each piece: those that end in it; an empty last unit belongs to the piece that it closes.
        white = np.searchsorted(np.flatnonzero(_IS_WHITE[buf]), np.concatenate([[0], stop]))
        self.count = count = np.diff(white) + np.array([x[2] for x in group], np.int64)
        self.begin = np.cumsum(count) - count
        self.piece = np.repeat(np.arange(len(group)), count)

    def unit(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


def unit_hashes(some: list[bytes]) -> np.ndarray:
    """The hashes of units, as ``Cut`` has them."""
    buf = np.frombuffer(b"".join(some), np.uint8)
    end = np.cumsum([len(u) for u in some], dtype=np.int64)
    start = np.concatenate([[0], end])[:-1].astype(np.int64)
    up, down = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=c[1:])
    return mixed((c[end] - c[start]) * down[start])


class Path:
    """The code of the frequent units, and how often each stood after each context."""

    def __init__(self, frequent: list[bytes], counts: list[int], others: int):
        self.units = frequent
        self.escape = len(frequent)
        self.code = Code([*map(float, counts), float(max(others, 1))]) if frequent else None
        h = unit_hashes(frequent)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.width = self.escape + 1

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not self.escape:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), self.escape - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.escape)

    def contexts(self, symbol: np.ndarray, cut: Cut, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last commonest unit before each (``COMMONEST`` if none), given those before each piece; and those after each piece."""
        n, at = len(symbol), np.arange(len(symbol))
        last = np.maximum.accumulate(np.where(symbol < min(COMMONEST, self.escape), at, -1)) if n else at
        earlier = np.concatenate([[-1], last[:-1]]) if n else last
        begin = cut.begin[cut.piece]
        out = np.where(earlier >= begin, symbol[np.maximum(earlier, 0)], before[cut.piece])
        end = cut.begin + cut.count - 1
        after = before.copy()
        some = cut.count > 0
        tail = last[np.maximum(end, 0)] if n else end
        met = some & (tail >= cut.begin)
        after[met] = symbol[tail[met]]
        return out, after


def path_gates(seen: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The set of weights: by the class of how often the context was seen at the node, and by the node's depth."""
    return ((seen > 0).astype(np.int64) + (seen > 3) + (seen > 30)) * 3 + (depth > 2) + (depth > 7)


def _logit(n1, n0):
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


class PathModel:
    """The logarithm of each unit's probability after each context, for each expert: the mixture, no context, the context alone."""

    def __init__(self, path: Path, pairs: np.ndarray):
        self.path = path
        n, width = COMMONEST + 1, path.width
        self.log = np.zeros((EXPERTS, n, width), np.float32)
        if path.code is None:
            return
        pairs = pairs.reshape(n, width).astype(np.float32)
        owner, place = path.code.bits(np.arange(width))
        node, bit = path.code.node[place].astype(np.int64), path.code.bit[place]
        depth, nodes = place - path.code.start[owner], width - 1
        ends = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])

        def counted(w):
            return np.bincount(node[bit], w[owner][bit], nodes).astype(np.float32), np.bincount(node[~bit], w[owner][~bit], nodes).astype(np.float32)

        every = counted(pairs.sum(axis=0))
        own = [counted(w) for w in pairs]
        self.weights = np.tile(np.array([0.5, 0.5], np.float32), (PATH_GATES, 1))
        total = np.zeros((PATH_GATES, 2, 3))
        for w, (n1, n0) in zip(pairs, own):
            at = np.flatnonzero(w[owner] > 0)
            y, k = bit[at], node[at]
            x = [_logit(np.maximum(e1[k] - y, 0), np.maximum(e0[k] - ~y, 0)) for e1, e0 in (every, (n1, n0))]
            g = path_gates(n1[k] + n0[k] - 1, depth[at])
            z = sum(v * self.weights[g, j] for j, v in enumerate(x))
            total += slopes(x, g, 1 / (1 + np.exp(-np.clip(z, -30, 30))), y, w[owner[at]], PATH_GATES)
        stepped(self.weights, total)
        alone = _logit(*every)[node]
        for f, (n1, n0) in enumerate(own):
            here, g = _logit(n1, n0)[node], path_gates((n1 + n0)[node], depth)
            for k, z in enumerate((alone * self.weights[g, 0] + here * self.weights[g, 1], alone, here)):
                z = np.clip(np.where(bit, z, -z), -24, 24)
                self.log[k, f] = -np.add.reduceat(np.log1p(np.exp(-z)), ends)

    def nats(self, symbol: np.ndarray, context: np.ndarray, extra: np.ndarray, cut: Cut, theta: np.ndarray) -> np.ndarray:
        """The nats of each unit, ``extra`` being those of its spelling. theta: the pieces' weights of the experts, which go on."""
        logs = self.log[:, context, symbol]
        out = np.empty(len(symbol))
        at = np.arange(len(symbol)) - cut.begin[cut.piece]
        order = np.argsort(at // BLOCK, kind="stable")
        ends = np.concatenate([[0], np.flatnonzero(np.diff(at[order] // BLOCK)) + 1, [len(order)]]) if len(order) else [0]
        for a, b in zip(ends[:-1], ends[1:]):
            rows = order[a:b]
            piece, x = cut.piece[rows], logs[:, rows]
            w = np.exp(theta - theta.max(axis=1, keepdims=True))
            w = (w / w.sum(axis=1, keepdims=True))[piece].T
            top = x.max(axis=0)
            part = w * np.exp(x - top)
            p = part.sum(axis=0)
            out[rows] = -(np.log(p) + top)
            for k in range(EXPERTS):
                theta[:, k] += RATE * np.bincount(piece, part[k] / p - w[k], len(theta))
        return out + extra


FIRST_WEIGHTS = (1.5, 0.0, 0.0)


def empty_tables(sizes: tuple[int, ...] = SLOTS) -> list[np.ndarray]:
    return [np.zeros((2, m), np.int64) for m in sizes]


def add_units(count: dict[bytes, int], tables: list[np.ndarray]) -> None:
    every = list(count)
    for i in range(0, len(every), _AT_ONCE):
        some = every[i : i + _AT_ONCE]
        n = np.array([count[u] for u in some], np.int64)
        unit, bit, slots, _ = bits(some, tuple(t.shape[1] for t in tables))
        times = n[unit]
        for t, s in zip(tables, slots):
            np.add.at(t.reshape(-1), s + bit * t.shape[1], times)


def _count(batches):
    """Texts to rows (unit, n), each at most once for so many units as a task holds."""
    held: Counter = Counter()

    def passed():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["unit", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(units(folded(text)))
            if len(held) >= _FLUSH:
                yield passed()
                held.clear()
    yield passed()


def _segments(flat: np.ndarray):
    """A task's counts as rows (segment, salt, sums)."""
    if flat.any():
        salt = xxhash.xxh32_intdigest(flat[:: max(1, len(flat) // 4096)].tobytes()) % _SALTS
        blobs = [_packed(p) for p in np.array_split(flat, _SEGMENTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SEGMENTS), pa.int32()), pa.array([salt] * _SEGMENTS, pa.int32()), pa.array(blobs, pa.binary())], names=["segment", "salt", "sums"])


def _tabulate(sizes: tuple[int, ...]):
    """A map of units and their counts to the segments of one set of tables."""

    def run(batches):
        tables = empty_tables(sizes)
        for batch in batches:
            add_units(dict(zip(*(c.to_pylist() for c in batch.columns))), tables)
        yield from _segments(np.concatenate([t.ravel() for t in tables]))

    return run


def _packed(counts: np.ndarray) -> bytes:
    top = counts.max(initial=0)
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"u{blob[0]}").astype(np.int64)


def _add(batches):
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for s, k, b in zip(*(c.to_pylist() for c in batch.columns)):
            x = _counts(b)
            sums[s, k] = sums[s, k] + x if (s, k) in sums else x
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([_packed(sums[k]) for k in keys], pa.binary())], names=["segment", "salt", "sums"])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sums of all tasks' segments (of a fixed size), added in two levels."""
    schema = "segment int, salt int, sums binary"
    salted = parts.repartition("segment", "salt").mapInArrow(_add, schema)
    out = np.zeros(size, np.uint32)
    segments = np.array_split(out, _SEGMENTS)
    for r in salted.withColumn("salt", F.lit(0)).repartition("segment").mapInArrow(_add, schema).toLocalIterator():
        segments[r["segment"]][:] = np.minimum(_counts(r["sums"]), 0xFFFFFFFF)
    return out


def spelling(flat: np.ndarray, sizes: tuple[int, ...] = SLOTS) -> list[np.ndarray]:
    """The spelling predictors' tables from their joint counts."""
    out, i = [], 0
    for m in sizes:
        out.append(flat[i : i + 2 * m].reshape(2, m))
        i += 2 * m
    return out


def total_slope(parts: DataFrame, shape: tuple) -> np.ndarray | None:
    """The sum of rows (i, x) as an array; None if there are none."""
    rows = parts.groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(math.prod(shape))
    for r in rows:
        flat[r["i"]] = r["x"]
    return flat.reshape(shape) if rows else None


def _sum_rows(total):
    if not isinstance(total, float):
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "x"])


def fit(model: Model, counts: DataFrame) -> None:
    """Moves the spelling weights down the cost of all training units that are spelled."""
    now = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = 0.0
        for batch in batches:
            total = total + now.value.slope(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        yield from _sum_rows(total)

    found = total_slope(counts.select("unit", "n").mapInArrow(sliced(run, _AT_ONCE), "i int, x double"), (GATES, len(SLOTS), len(SLOTS) + 1))
    if found is not None:
        model.step(found)
    now.destroy()


def paired(path: Path):
    """A map over texts to the segments of the counts of (context, symbol)."""

    def run(batches):
        counts = np.zeros((COMMONEST + 1) * path.width, np.uint32)
        for batch in batches:
            before, text = np.full(1, COMMONEST), -1
            for group in pieces([folded(t) for t in batch.column(0).to_pylist()]):
                cut = Cut(group)
                symbol = path.symbols(cut.hash)
                start = np.full(len(group), COMMONEST)
                if group[0][0] == text:  # the text before goes on
                    start[0] = before
                context, after = path.contexts(symbol, cut, start)
                np.add.at(counts, context * path.width + symbol, 1)
                before, text = after[-1], group[-1][0] if not group[-1][2] else -1
        yield from _segments(counts)

    return run


_KNOWN = 400_000


_memory: dict = {}  # what this process has worked out for units of the model it last used


class Reader:
    """Scores texts; remembers what it has worked out for units that are spelled."""

    def __init__(self, common: dict[bytes, int], path_model: PathModel, model: Model, sent: tuple | None = None):
        self.path, self.paths, self.model = path_model.path, path_model, model
        #: Sorted hashes of spelled units with their costs, logarithms of word counts, and whether they are words.
        self.sent = sent if sent is not None else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, bool))
        self.logs = {w: math.log10(c + 0.1) for w, c in common.items()}
        part, worded = self._facts(self.path.units)
        # The place behind the frequent units stands for all that are spelled.
        self.own = np.append(part, 0.0), np.append(worded, False)
        self._forget()

    def _facts(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each unit's word count (0 for white space, nan for a word that is not common), and whether it is a word."""
        words = [u.rstrip(_WHITE) for u in some]
        return np.array([self.logs.get(w, math.nan) if w else 0.0 for w in words], float), np.array([bool(w) for w in words], bool)

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.cost, self.part, self.worded = np.zeros(_KNOWN), np.zeros(_KNOWN), np.zeros(_KNOWN, bool)

    def spelled(self, some: list[bytes]) -> np.ndarray:
        """Rows of units that are not frequent; new ones are worked out together."""
        new = [u for u in dict.fromkeys(some) if u not in self.row]
        if len(self.row) + len(new) > _KNOWN:
            self._forget()
            new = list(dict.fromkeys(some))
        for i in range(0, len(new), _AT_ONCE):
            block, k = new[i : i + _AT_ONCE], len(self.row)
            at = slice(k, k + len(block))
            self.cost[at] = self.model.costs(block)
            self.part[at], self.worded[at] = self._facts(block)
            self.row.update(zip(block, range(k, k + len(block))))
        return np.fromiter(map(self.row.__getitem__, some), np.int64, len(some))

    def read(self, raws: list[bytes]) -> list[tuple]:
        """For each text: n_tokens, n_common, common_part, n_bytes, phrases (hashes, nats) and rare words (Counter)."""
        n = len(raws)
        words, known, part_sum = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        rare: list[Counter] = [Counter() for _ in range(n)]
        keys: list[list] = [[] for _ in range(n)]
        nats: list[list] = [[] for _ in range(n)]
        going = None  # what a text that goes on in the next group left
        for group in pieces(raws):
            cut = Cut(group)
            text = np.array([g[0] for g in group])
            start, theta = np.full(len(group), COMMONEST), np.tile(np.array(FIRST_WEIGHTS), (len(group), 1))
            if going is not None and going[0] == group[0][0]:
                start[0], theta[0] = going[1], going[2]
            symbol = self.path.symbols(cut.hash)
            context, after = self.path.contexts(symbol, cut, start)
            at = np.flatnonzero(symbol == self.path.escape)
            part, worded, extra = self.own[0][symbol], self.own[1][symbol], np.zeros(len(symbol))
            if len(at) and len(self.sent[0]):
                place = np.minimum(np.searchsorted(self.sent[0], cut.hash[at]), len(self.sent[0]) - 1)
                met = self.sent[0][place] == cut.hash[at]
                place, met_at = place[met], at[met]
                extra[met_at], part[met_at], worded[met_at] = self.sent[1][place], self.sent[2][place], self.sent[3][place]
                at = at[~met]
            if len(at):
                some = list(map(cut.raw.__getitem__, map(slice, cut.start[at].tolist(), cut.end[at].tolist())))
                row = self.spelled(some) if len(at) <= _KNOWN // 2 else None
                if row is None:  # in parts, as they may not all be held
                    half = [self._taken(some[i : i + _KNOWN // 2]) for i in range(0, len(some), _KNOWN // 2)]
                    extra[at], part[at], worded[at] = (np.concatenate([h[k] for h in half]) for k in range(3))
                else:
                    extra[at], part[at], worded[at] = self.cost[row], self.part[row], self.worded[row]
            cost = self.paths.nats(symbol, context, extra, cut, theta)
            owner = text[cut.piece]
            odd = np.isnan(part)
            words += np.bincount(owner, worded, n).astype(np.int64)
            known += np.bincount(owner, worded & ~odd, n).astype(np.int64)
            part_sum += np.bincount(owner, np.where(odd, 0.0, part), n)
            for i in np.flatnonzero(odd).tolist():
                rare[owner[i]][cut.unit(i).rstrip(_WHITE)] += 1
            if len(symbol):
                self._phrases(cut, cost, text, keys, nats, going)
            going = None if group[-1][2] else (group[-1][0], after[-1], theta[-1].copy(), self._open)
        return [(int(words[i]) + 1, int(known[i]), float(part_sum[i]), len(raws[i]), np.concatenate(keys[i]), np.concatenate(nats[i]), rare[i]) for i in range(n)]

    def _taken(self, some: list[bytes]):
        row = self.spelled(some)
        return self.cost[row], self.part[row], self.worded[row]

    def _phrases(self, cut: Cut, cost: np.ndarray, text: np.ndarray, keys: list, nats: list, going) -> None:
        """Adds the phrases of a group to their texts; one that a piece of a long text does not end is kept open, and has a key of its own."""
        stop = cut.last | (cut.hash % np.uint64(PHRASE) == 0)
        shown = np.flatnonzero(cut.end > cut.start)
        line = np.zeros(len(stop), bool)
        line[shown] = np.frombuffer(cut.raw, np.uint8)[cut.end[shown] - 1] == 10
        stop |= line
        up, down = _powers(len(stop) + 1)
        h = np.where(cut.last, cut.hash ^ np.uint64(0x5555555555555555), cut.hash)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        total = np.concatenate([[0.0], np.cumsum(cost)])
        end = np.flatnonzero(stop) + 1
        if not len(end) or end[-1] < len(stop):
            end = np.append(end, len(stop))
            left = True
        else:
            left = False
        begin = np.concatenate([[0], end[:-1]])
        key, price = mixed((sums[end] - sums[begin]) * down[begin]), total[end] - total[begin]
        if going is not None and going[0] == text[0] and going[3] is not None:
            # The open phrase of the text before this group is its start.
            key[:1] = mixed(going[3][0] * np.uint64(0x9E3779B97F4A7C15) + key[:1])
            price[0] += going[3][1]
        self._open = (key[-1:].copy(), price[-1]) if left else None
        if left:
            key, price, end = key[:-1], price[:-1], end[:-1]
        owner = text[cut.piece[end - 1]]
        for t in np.unique(owner).tolist():
            of = slice(*np.searchsorted(owner, (t, t + 1)))
            keys[t].append(key[of].view(np.int64))
            nats[t].append(price[of])


_RARE = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())]))


def _reader(shared, ready, model_name: str):
    def read(batches):
        if _memory.get("model") != model_name:
            _memory.clear()
            _memory.update(model=model_name, reader=Reader(*shared.value, ready.value))
        reader = _memory["reader"]
        for batch in batches:
            rows = reader.read([folded(t) for t in batch.column(2).to_pylist()])
            cols = list(zip(*rows)) or [[]] * 7
            ends = pa.array(np.cumsum([0, *map(len, cols[4])]).astype(np.int32))
            keys, nats = (np.concatenate([np.zeros(0, t), *c]) for t, c in ((np.int64, cols[4]), (np.float64, cols[5])))
            phrases = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(keys), pa.array(nats)], names=["h", "nats"]))
            rare = pa.array([[{"word": w, "m": m} for w, m in c.items()] for c in cols[6]], _RARE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), phrases, rare], names=["id", "held_out", "n_tokens", "n_common", "common_part", "n_bytes", "phrases", "rare"])

    return read


def with_memory(done: DataFrame) -> DataFrame:
    """(row, nats): the logarithm of each text's probability when its phrases may also come from other training texts."""
    said = done.select("row", "held_out", F.explode("phrases").alias("p")).select("row", "held_out", "p.h", "p.nats")
    counted = said.where("not held_out").groupBy("h").agg(F.count("*").alias("c"))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    met = said.join(counted, "h", "left")
    others = F.greatest(F.coalesce("c", F.lit(0)) - F.when(F.col("held_out"), 0).otherwise(1), F.lit(0)) / F.lit(max(total, 1))
    plain = -F.col("nats")
    cost = []
    for i, s in enumerate(SHARES):
        remembered, own = F.log(others * s), plain + math.log1p(-s)
        both = F.greatest(own, remembered) + F.log1p(F.exp(-F.abs(own - remembered)))
        cost.append(F.sum(F.when(others > 0, both).otherwise(own)).alias(f"share{i}"))
    sums = met.groupBy("row").agg(*cost)
    every = F.array(*[F.col(f"share{i}") for i in range(len(SHARES))])
    top = F.array_max(every)
    mean = F.aggregate(every, F.lit(0.0), lambda a, x: a + F.exp(x - top)) / len(SHARES)
    return sums.select("row", (top + F.log(mean)).alias("nats"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    stash = Stash(spark)
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    learnt = src.where("not held_out").select("text")
    seen_units = stash(learnt.mapInArrow(sliced(_count), "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    stash.free()
    n_train = src.where("not held_out").count()
    white = F.hex(F.substring("unit", -1, 1)).isin("20", "09", "0A", "0B", "0C", "0D")
    word = F.when(white, F.expr("substring(unit, 1, octet_length(unit) - 1)")).otherwise(F.col("unit"))
    counts = stash(seen_units.select(word.alias("word"), "n").where(F.octet_length("word") > 0).groupBy("word").agg(F.sum("n").alias("c")))
    # The end of each training document is a token as well, one that no word equals.
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    n_all, n_kinds = words + n_train, kinds + (n_train > 0)
    common = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(frequent).collect()}

    n_units = seen_units.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    top = seen_units.where("n > 1").orderBy(F.desc("n"), "unit").limit(PATHS).collect()
    path = Path([bytes(r["unit"]) for r in top], [r["n"] for r in top], n_units - sum(r["n"] for r in top))
    sent = spark.sparkContext.broadcast(path)
    places = "segment int, salt int, sums binary"
    pairs = learnt.mapInArrow(sliced(lambda batches: paired(sent.value)(batches)), places)
    path_model = PathModel(path, summed(pairs, (COMMONEST + 1) * path.width))
    stash.free()
    frequent_units = frozenset(path.units)

    def unspelled(batches):
        for batch in batches:
            yield batch.filter(pa.array([u not in frequent_units for u in batch.column(0).to_pylist()], pa.bool_()))

    rest = stash(seen_units.mapInArrow(sliced(unspelled, _AT_ONCE), "unit binary, n long"))
    sizes = slots_for(n_units)
    model = Model(spelling(summed(rest.mapInArrow(sliced(_tabulate(sizes), _AT_ONCE), places), 2 * sum(sizes)), sizes))
    fit(model, rest)
    model.tables = []
    # How many units stand at least so often tells from which count on their costs are sent.
    often = rest.groupBy("n").agg(F.count("*").alias("c")).where("n > 1").orderBy(F.desc("n")).toLocalIterator()
    least, units_sent = 1 << 62, 0
    for r in often:
        units_sent += r["c"]
        if units_sent > SENT:
            break
        least = r["n"]
    shared = spark.sparkContext.broadcast((common, path_model, model))

    def costs(batches):
        known = Reader(*shared.value)
        for batch in batches:
            some = batch.column(0).to_pylist()
            h = unit_hashes(some)
            part, worded = known._facts(some)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(known.model.costs(some)), pa.array(part), pa.array(worded)], names=["h", "cost", "part", "worded"])

    t = rest.where(F.col("n") >= least).select("unit").mapInArrow(sliced(costs, _AT_ONCE), "h long, cost double, part double, worded boolean").toArrow()
    h = t.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    ready = spark.sparkContext.broadcast((h[order], *(t.column(c).to_numpy()[order] for c in ("cost", "part", "worded"))))
    stash.drop(rest)
    stash.drop(seen_units)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_common long, common_part double, n_bytes long, phrases array<struct<h: bigint, nats: double>>, rare array<struct<word: binary, m: bigint>>"
    done = stash(src.mapInArrow(sliced(_reader(shared, ready, uuid.uuid4().hex)), schema).withColumn("row", F.monotonically_increasing_id()))
    stash.free()
    asked = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m")
    met = asked.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("n_rare"), F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_part"))
    both = done.drop("rare", "phrases").join(met, "row", "left").join(with_memory(done), "row", "left")
    whole = math.log10(n_all + 0.1 * (n_kinds + 1))
    base = F.col("common_part") + F.coalesce("rare_part", F.lit(0.0)) + F.lit(math.log10(n_train + 0.1)) - F.col("n_tokens") * F.lit(whole)
    return both.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(n_train > 0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("nats") / F.lit(math.log(10))).alias("score"),
        (-F.col("nats") / F.lit(math.log(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
