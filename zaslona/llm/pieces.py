"""SentencePiece encoding and decoding by a max-plus scan.

The ids are those of the model's own library. Such a model merges, again and again, the two neighbours whose union is
the piece of highest score. Whether two pieces can stand side by side in the result depends on these two alone: they
can if merging their joint text gives just them. An encoding is therefore the one path of pieces over a text all of
whose neighbours agree: a max-plus problem in which a pair that agrees weighs 0 and any other minus infinity. No piece
crosses the place between a word and the space mark after it, so such places are cuts, and the units between them are
solved alone and remembered.

A text of more than ``chunk`` characters is split into chunks anywhere. The state at a border is the piece that holds
the character before it. Each chunk yields the matrix of weights from every state at its start to every state at its
end. Matrices are multiplied in the max-plus algebra: ``SEGMENT`` neighbours in one task, a text's segments in
another; that fixes the states at the segments' borders, from them those at the chunks' borders, and each chunk is
traced back on its own between its two states. The path is unique, so ids do not depend on where the chunks end.

Characters that no piece holds, and a literal U+2581, become the byte pieces of their UTF-8, so that decoding returns
every text exactly; the library would read a literal U+2581 as a space. Defined results: null has null ids and an
empty text none; repeated rows and null ids of documents are kept as rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
#: Chunks whose matrices one task multiplies.
SEGMENT = 256
MARK = "▁"
_LITERAL = "\ud800"  # stands for a mark that the text itself holds; no valid text has it
_CACHE, _PAIRS = 300_000, 1_000_000
#: Characters of a unit that is merged together with others; longer ones are solved along their pieces.
_SHORT = 48
_NONE = np.int32(1 << 30)


class Pieces:
    """A model's pieces and scores, with the solvers."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        score: dict[str, float] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                score[p], self.id[p] = sp.get_score(i), i
                self.bytes[i] = p.replace(MARK, " ").encode()
        self.width = max(map(len, self.id))
        # The piece of highest score is merged first; equal scores are one rank.
        levels = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: levels[s] for p, s in score.items()}
        self.rank_of = np.full(n + 1, _NONE, np.int32)
        for p, i in self.id.items():
            self.rank_of[i] = self.rank[p]
        self.has_cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.char = np.full(0x110000, n, np.int64)  # n: no piece
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self._table()
        self.agree: dict[tuple[str, str], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.size, self.flat, self.used = np.zeros(_CACHE, np.int64), np.zeros(8 * _CACHE, np.int32), 0
        self.start = np.zeros(_CACHE, np.int64)

    def _table(self) -> None:
        """A hash table from pairs of pieces to the piece that they form."""
        keys, values = [], []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                if (a := self.id.get(p[:k])) is not None and (b := self.id.get(p[k:])) is not None:
                    keys.append(a * self.n + b)
                    values.append(i)
        self.shift = np.uint64(64 - max(10, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        key, value = np.full(size, -1, np.int64), np.full(size, self.n, np.int64)
        slot, most = self._slot(np.array(keys, np.int64)), 1
        for k, v, s in zip(keys, values, slot.tolist()):
            steps = 1
            while key[s] >= 0:
                s, steps = (s + 1) % size, steps + 1
            key[s], value[s], most = k, v, max(most, steps)
        self.key, self.value, self.probes = key, value, most

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that pairs of pieces form, n where they form none."""
        keys = a * self.n + b
        keys[(a >= self.n) | (b >= self.n)] = -2
        at = self._slot(keys)
        out = np.full(len(keys), self.n, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            met = self.key[at]
            same = met == keys[todo]
            out[todo[same]] = self.value[at[same]]
            more = ~same & (met >= 0)
            todo, at = todo[more], (at[more] + 1) % len(self.key)
            if not len(todo):
                break
        return out

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(_NONE, 0))
            if best[0] == _NONE:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stand(self, a: str, b: str) -> bool:
        """Whether two pieces (or characters without one) agree."""
        if (hit := self.agree.get((a, b))) is None:
            if len(self.agree) >= _PAIRS:
                self.agree.clear()
            hit = self.agree[a, b] = self.merged(a + b) == [a, b]
        return hit

    def solve(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short units, one after another, and how many each has: all are merged side by side."""
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(some)), [len(u) for u in some])
        symbol, point = self.char[points], points.copy()
        open_ = np.ones(len(some), bool)
        done: list[tuple] = []
        while len(symbol):
            joint = np.full(len(symbol), self.n, np.int64)
            joint[:-1] = self.union(symbol[:-1], symbol[1:])
            joint[:-1][owner[1:] != owner[:-1]] = self.n
            rank = self.rank_of[joint]
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.concatenate([start, [len(owner)]]))
            best = np.minimum.reduceat(rank, start)
            still = np.repeat(best < _NONE, size)
            if not still.all():
                done.append((owner[~still], symbol[~still], point[~still]))
            at = np.flatnonzero(still & (rank == np.repeat(best, size)))
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])] if len(at) else at  # the leftmost
            symbol[at] = joint[at]
            keep = still
            keep[at + 1] = False
            symbol, owner, point = symbol[keep], owner[keep], point[keep]
        owner, symbol, point = (np.concatenate(c) for c in zip(*done)) if done else (owner, symbol, point)
        order = np.argsort(owner, kind="stable")
        owner, symbol, point = owner[order], symbol[order], point[order]
        odd = np.flatnonzero(symbol == self.n)
        if len(odd):
            raw = [self.spelled(chr(p)) for p in point[odd].tolist()]
            many = np.ones(len(symbol), np.int64)
            many[odd] = [len(r) for r in raw]
            owner, first = np.repeat(owner, many), np.cumsum(many) - many
            symbol = np.repeat(symbol, many)
            symbol[np.concatenate([f + np.arange(len(r)) for f, r in zip(first[odd], raw)])] = np.concatenate(raw)
        return symbol.astype(np.int32), np.bincount(owner, minlength=len(some))

    def spelled(self, piece: str) -> list[int]:
        """The ids of a piece, or of the bytes of a character that has none."""
        if (i := self.id.get(piece)) is not None:
            return [i]
        return [self.byte_id[b] for b in (MARK if piece == _LITERAL else piece).encode("utf-8", "surrogatepass")]

    def walk(self, text: str, start: int, end: int, first: str | None, like: list | None = None) -> tuple[list, bool]:
        """For each place up to ``end`` the last piece of the only path from ``start``, whose pieces follow ``first``; None where no path ends.

        ``like`` is a former walk over the same text: once this one takes the same places for the width of a piece, it
        goes on alike, and the walk ends with True.
        """
        last: list = [None] * (end + 1)
        last[start] = first if first is not None else ""
        known, stand, width, same, void = self.id, self.stand, self.width, 0, 0
        for e in range(start + 1, end + 1):
            for s in range(max(start, e - width), e):
                before = last[s]
                if before is None:
                    continue
                piece = text[s:e]
                if (piece in known or e - s == 1) and (stand(before, piece) if before else self.merged(piece) == [piece]):
                    last[e] = piece
                    break
            void = void + 1 if last[e] is None else 0
            if void > width:
                break
            if like is not None:
                same = same + 1 if last[e] == like[e] else 0
                if same > width and last[e] is not None:
                    return last, True
        return last, False

    def back(self, last: list, start: int, end: int) -> list[str]:
        """The pieces of a walk between two places."""
        out = []
        while end > start:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def cut(self, text: str) -> list[str]:
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text) if self.has_cuts else [text]

    def rows(self, units: list[str]) -> np.ndarray:
        """Where the ids of units are kept; new ones are solved together."""
        new = [u for u in dict.fromkeys(units) if u not in self.row]
        if len(self.row) + len(new) > _CACHE:
            self._forget()
            new = list(dict.fromkeys(units))
        short = [u for u in new if len(u) <= _SHORT]
        found = []
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            found.append((part, *self.solve(part)))
        for u in new:
            if len(u) > _SHORT:
                ids = [x for p in self.back(self.walk(u, 0, len(u), None)[0], 0, len(u)) for x in self.spelled(p)]
                found.append(([u], np.array(ids, np.int32), np.array([len(ids)])))
        for names, ids, size in found:
            k, n = len(self.row), len(ids)
            if self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(n, len(self.flat)), np.int32)])
            self.flat[self.used : self.used + n] = ids
            self.size[k : k + len(names)] = size
            self.start[k : k + len(names)] = self.used + np.cumsum(size) - size
            self.used += n
            self.row.update(zip(names, range(k, k + len(names))))
        return np.fromiter(map(self.row.__getitem__, units), np.int64, len(units))

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in turn, and how many each has."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(units), _CACHE // 2):
            at = self.rows(units[i : i + _CACHE // 2])
            size = self.size[at]
            ends = np.cumsum(size)
            where = np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            parts.append(self.flat[where])
            sizes.append(size)
        return np.concatenate(parts), np.concatenate(sizes)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of texts; None for null."""
        units = [self.cut(marked(t)) if t else [] for t in texts]
        flat, size = self.ids([u for every in units for u in every])
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, units)])]
        return [None if t is None else flat[a:b] for t, a, b in zip(texts, ends, ends[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts in front is taken off."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]

    # Chunks. A state at a border is (a, b): the piece that holds a characters before it, a > 0, and b after it. Before
    # a text's first character there is one state, (0, 0).

    def states(self, before: str, after: str) -> list[tuple[int, int]]:
        """All states that a border between these characters can have."""
        if not before:
            return [(0, 0)]
        out = []
        for a in range(1, min(self.width, len(before)) + 1):
            for b in range(0, min(self.width - a, len(after)) + 1):
                if a + b == 1 or before[len(before) - a :] + after[:b] in self.id:
                    out.append((a, b))
        return out

    def _parts(self, body: str) -> list[int]:
        return [m.start() + 1 for m in re.finditer(f"[^{MARK}](?={MARK})", body) if m.start() + 1 < len(body)] if self.has_cuts else []

    def _piece(self, behind: str, body: str, ahead: str, state: tuple[int, int]) -> str | None:
        a, b = state
        return (behind[len(behind) - a :] if a else "") + (body + ahead)[:b] or None

    def _leaving(self, whole: str, n: int, last: list, start: int, out: list[tuple[int, int]]) -> np.ndarray:
        """Which states at the end of a chunk of n characters a walk from ``start`` reaches."""
        row = np.full(len(out), -np.inf, np.float32)
        for j, (a, b) in enumerate(out):
            s = n - a
            if s >= start and last[s] is not None:
                piece = whole[s : n + b]
                if self.stand(last[s], piece) if last[s] else self.merged(piece) == [piece]:
                    row[j] = 0
        return row

    def matrix(self, behind: str, body: str, ahead: str) -> np.ndarray:
        """Weights from each state at the start of body to each at its end."""
        n, whole = len(body), body + ahead
        into, out = self.states(behind, whole), self.states(behind + body, ahead)
        got = np.full((len(into), len(out)), -np.inf, np.float32)
        cuts = self._parts(body)
        tail = self._leaving(whole, n, self.walk(whole, cuts[-1], n, None)[0], cuts[-1], out) if cuts else None
        known: list[tuple[list, np.ndarray]] = []
        for i, state in enumerate(into):
            b, piece = state[1], self._piece(behind, body, ahead, state)
            if b >= n and state[0]:  # one piece over the whole chunk
                got[i] = [0 if s == (state[0] + n, b - n) else -np.inf for s in out]
                if b > n:
                    continue
            if b > n or (cuts and b > cuts[0]):
                continue
            end = cuts[0] if cuts else n
            last, same = self.walk(whole, b, end, piece, known[0][0] if known else None)
            if same:
                row = known[0][1]
            elif cuts:
                row = tail if last[end] is not None else None
            else:
                row = self._leaving(whole, n, last, b, out)
            if row is not None and np.isfinite(row).any():
                got[i] = np.maximum(got[i], row)
                if not known:
                    known.append((last, row))
        return got

    def between(self, behind: str, body: str, ahead: str, enter: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, between two states."""
        n, whole = len(body), body + ahead
        (ea, b), (a, over) = self.states(behind, whole)[enter], self.states(behind + body, ahead)[leave]
        first = self._piece(behind, body, ahead, (ea, b))
        if a > n or (a == n and b >= n and ea):  # the piece begins before the chunk
            return []
        cuts, stop = self._parts(body), n - a
        head = min(cuts[0], stop) if cuts else stop
        out = [x for p in self.back(self.walk(whole, b, head, first)[0], b, head) for x in self.spelled(p)]
        if head < stop:
            last = max(c for c in cuts if c <= stop)
            out += self.ids(self.cut(body[head:last]))[0].tolist()
            out += [x for p in self.back(self.walk(whole, last, stop, None)[0], last, stop) for x in self.spelled(p)]
        return out + self.spelled(whole[stop : n + over])


_loaded: dict[str, Pieces] = {}


def pieces(path: str = MODEL) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def marked(text: str) -> str:
    """Text as pieces see it: a space in front, spaces as marks."""
    return MARK + text.replace(MARK, _LITERAL).replace(" ", MARK)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product in the max-plus algebra."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbours, by halves: the algebra is associative."""
    while len(matrices) > 1:
        matrices = [reduce(times, matrices[i : i + 2]) for i in range(0, len(matrices), 2)]
    return matrices[0]


def scan(matrices: list[np.ndarray], enter: int | None = None, leave: int | None = None) -> list[int]:
    """Best states at the borders of neighbours, both ends included, which may be given."""
    v = np.zeros(matrices[0].shape[0], np.float32)
    if enter is not None:
        v[:] = -np.inf
        v[enter] = 0
    before = []
    for t in matrices:
        before.append(v)
        v = (v[:, None] + t).max(axis=0)
    states = [int(np.argmax(v)) if leave is None else leave]
    for v, t in zip(reversed(before), reversed(matrices)):
        states.append(int(np.argmax(v + t[:, states[-1]])))
    return states[::-1]


def with_ids(docs: DataFrame, text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The documents' columns (or ``keep``) with ids (array<int>), and with round_trip (boolean) if ``check``: whether decoding gives the text."""
    spark = docs.sparkSession
    import pandas as pd

    made = ["ids", "round_trip"] if check else ["ids"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]

    def encode(batches):
        p = pieces(model)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            every = p.encode_all(texts)
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in every)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *(x for x in every if x is not None)])
            void = pa.array([x is None for x in every], pa.bool_())
            out = [*batch.columns[: len(names)], pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=void)]
            if check:
                out.append(pa.array([t is None or (p.decode(x.tolist()) if len(x) else "") == t for t, x in zip(texts, every)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *made])

    few = docs.select(*names, F.col(text_col).alias("__text"))
    schema = few.drop("__text").withColumn("ids", F.lit(None).cast("array<int>"))
    schema = (schema.withColumn("round_trip", F.lit(None).cast("boolean")) if check else schema).schema
    short = few.where(F.col("__text").isNull() | (F.length("__text") <= chunk)).mapInArrow(sliced(encode), schema)
    stash = Stash(spark)
    # The key of a long document is its place in a written table, which stays as it is.
    long = stash(few.where(F.length("__text") > chunk).withColumn("__key", F.monotonically_increasing_id()))

    def raw(text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def split(batches):
        w = pieces(model).width
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = marked(text)
                for no, i in enumerate(range(0, len(t), chunk)):
                    parts = (t[max(0, i - w) : i], t[i : i + chunk], t[i + chunk : i + chunk + w])
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([no], pa.int32()), *(pa.array([raw(x)]) for x in parts)], names=["k", "no", "behind", "body", "ahead"])

    chunks = stash(long.select(F.col("__key").alias("k"), F.col("__text").alias("t")).mapInArrow(sliced(split), "k long, no int, behind binary, body binary, ahead binary"))

    def measure(batches):
        p = pieces(model)
        for batch in batches:
            for r in batch.to_pylist():
                m = p.matrix(*(r[c].decode("utf-8", "surrogatepass") for c in ("behind", "body", "ahead")))
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]]), pa.array([r["no"]], pa.int32()), pa.array([r["no"] // SEGMENT], pa.int32()), pa.array([m.shape[0]], pa.int32()), pa.array([m.tobytes()])], names=["k", "no", "segment", "n", "m"])

    def matrices(f) -> list[np.ndarray]:
        return [np.frombuffer(m, np.float32).reshape(n, -1) for m, n in zip(f["m"], f["n"])]

    def segment(f):
        m = product(matrices(f.sort_values("no")))
        return pd.DataFrame({"k": [f["k"].iat[0]], "segment": [f["segment"].iat[0]], "n": [m.shape[0]], "m": [m.tobytes()]})

    def settle(f):
        f = f.sort_values("segment")
        states = scan(matrices(f))
        return pd.DataFrame({"k": f["k"], "segment": f["segment"], "first": states[:-1], "last": states[1:]})

    def inside(f):
        f = f.sort_values("no")
        states = scan(matrices(f), int(f["first"].iat[0]), int(f["last"].iat[0]))
        return pd.DataFrame({"k": f["k"], "no": f["no"], "enter": states[:-1], "leave": states[1:]})

    def back(batches):
        p = pieces(model)
        for batch in batches:
            for r in batch.to_pylist():
                ids = p.between(*(r[c].decode("utf-8", "surrogatepass") for c in ("behind", "body", "ahead")), r["enter"], r["leave"])
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]]), pa.array([r["no"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["k", "no", "ids"])

    by_chunk = chunks.repartition("k", "no")
    measured = stash(by_chunk.mapInArrow(sliced(measure), "k long, no int, segment int, n int, m binary"))
    segments = measured.groupBy("k", "segment").applyInPandas(segment, "k long, segment int, n int, m binary")
    borders = segments.groupBy("k").applyInPandas(settle, "k long, segment int, first int, last int")
    states = measured.join(borders, ["k", "segment"]).groupBy("k", "segment").applyInPandas(inside, "k long, no int, enter int, leave int")
    traced = by_chunk.join(states, ["k", "no"]).mapInArrow(sliced(back), "k long, no int, ids array<int>")
    whole = traced.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts")).select(F.col("k").alias("__key"), F.flatten("parts.ids").alias("ids"))
    both = long.join(whole, "__key")
    same = [(decoder(model)(F.col("ids")) == F.col("__text")).alias("round_trip")] if check else []
    return short.unionByName(both.select(*names, "ids", *same))


def decoder(model: str = MODEL):
    """A column function: the text of an array of ids."""
    import pandas as pd

    @F.pandas_udf("string")
    def decode(ids):
        p = pieces(model)
        return pd.Series([None if x is None else p.decode(x) if len(x) else "" for x in ids], dtype=object)

    return decode
