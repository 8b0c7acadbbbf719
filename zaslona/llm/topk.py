"""Exact top-k inner-product search with MaxScore.

A component is a term; its weight for a candidate is its part of the score above the least that the shard allows, so
weights are never negative and a partial sum is a lower bound. Terms of a block of queries are ordered by the largest
weight they can have; the tail whose largest weights cannot lift a candidate over a query's floor is non-essential.
The essential terms are traversed for a whole shard and block as one matrix product; the others are probed, a few at a
time, only for the pairs of query and candidate that the bounds of what is left still let compete.

A query's floor is a score that k candidates are known to reach: at first among a sample of all candidates, then among
the best that a task has met, so it only rises. A query whose largest possible score in a shard is below its floor
skips that shard. Candidates are sorted within their partition by their two largest components, so that the bounds of
a shard are as narrow as the data allow; equal vectors stand together and cost one row of the product.

Candidates are read where they are stored, once for each block of queries, and are never copied or shuffled. A block
of at most ``BLOCK_VALUES`` components is sent to all tasks; a task passes on at most k rows for a query, which are
merged by rank.

Defined results: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as
zero beyond its end; rows with a null id are dropped; candidates with the query's id are its own; a query that is
repeated with the same vector is answered once; ties go to the smaller id; rows of one id and score are ranked apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

#: Candidates that are taken together; components of the queries that are sent at once (8 bytes each).
SHARD_ROWS, BLOCK_VALUES = 4096, 1 << 22
#: Candidates that give the first floors. Any number gives right results.
SAMPLE_ROWS = 2048
_TOGETHER, _PROBE, _FEW = 512, 8, 64
_LEAST = {np.float32: -(2**24), np.float64: -(2**53), np.int64: -(2**62)}
_FOUND = "query_id long, query_hash long, vec_id long, score long"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    ends = column.offsets.to_numpy()
    flat, size = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def held_as(q: np.ndarray, x: np.ndarray):
    """The fastest type that holds all sums exactly."""
    most = 4.0 * max(q.shape[1], 1) * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For queries and a shard's bounds: the least part of each term and how far above it the term can lift a score."""
    a, b = q * low, q * high
    return np.minimum(a, b), np.abs(a - b)


def competing(q: np.ndarray, x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (query, row) whose score reaches the query's floor, their scores, and how many products were made. floor: of the type of q."""
    base, span = reach(q, x.min(axis=0), x.max(axis=0))
    least, made = base.sum(axis=1), 0
    able = np.flatnonzero(least + span.sum(axis=1) >= floor)
    if not len(able):
        return able, able, np.zeros(0, q.dtype), made
    q, base, span, floor = q[able], base[able], span[able], floor[able]
    order = np.argsort(-span.sum(axis=0), kind="stable")
    # rest[:, t]: what the terms after the first t can add at most, over their least.
    tail = np.cumsum(span[:, order[::-1]], axis=1)[:, ::-1]
    rest = np.concatenate([tail, np.zeros((len(q), 1), q.dtype)], axis=1)
    dim = len(order)
    # rest falls with t: the terms before this place are essential to some query, no later one is to any.
    t = min(dim, int((least[:, None] + rest >= floor[:, None]).sum(axis=1).max()))
    lead, most = order[:t], q.shape[0] * x.shape[0] // _FEW
    got = q[:, lead] @ x[:, lead].T
    got += (least - base[:, lead].sum(axis=1))[:, None]
    made += got.size * t
    # While most pairs compete, the next terms are cheaper for all of them together.
    while True:
        live = got >= (floor - rest[:, t])[:, None]
        if t == dim or np.count_nonzero(live) <= most:
            break
        terms = order[t : t + _PROBE]
        t += len(terms)
        got += q[:, terms] @ x[:, terms].T
        got -= base[:, terms].sum(axis=1)[:, None]
        made += got.size * len(terms)
    pair_q, pair_x = np.nonzero(live)
    score = got[pair_q, pair_x]
    while t < dim and len(pair_q):
        terms = order[t : t + _PROBE]
        t += len(terms)
        score = score + np.einsum("ij,ij->i", q[:, terms][pair_q], x[:, terms][pair_x]) - base[:, terms].sum(axis=1)[pair_q]
        made += len(pair_q) * len(terms)
        live = score >= (floor - rest[:, t])[pair_q]
        pair_q, pair_x, score = pair_q[live], pair_x[live], score[live]
    return able[pair_q], pair_x, score, made


class Best:
    """The k best rows of each query of a block so far, and the floors that follow."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.floor, self.k = own, floor, k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh = 0

    def add(self, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        other = vec_id != self.own[query]
        self.query = np.concatenate([self.query, query[other]])
        self.id = np.concatenate([self.id, vec_id[other]])
        self.score = np.concatenate([self.score, score[other].astype(np.int64)])
        self.fresh += int(other.sum())
        if self.fresh > 4096 and self.fresh > len(self.own):
            self.settle()

    def settle(self) -> None:
        order = np.lexsort((self.id, -self.score, self.query))
        query = self.query[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        last = np.flatnonzero(np.arange(len(query)) - first == self.k - 1)
        at = query[last]
        self.floor[at] = np.maximum(self.floor[at], self.score[order][last])
        order = order[keep]
        self.query, self.id, self.score, self.fresh = self.query[order], self.id[order], self.score[order], 0


def _shards(batches, rows: int):
    """(vec_id, v) batches joined to about so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def searcher(block, k: int):
    """A map over candidates (vec_id, v): rows (query_id, query_hash, vec_id, score) of a task's k best for each query of the broadcast block."""

    def run(batches):
        ids, hashes, q, floor = block.value
        best = Best(ids, floor.copy(), k)
        for shard in _shards(batches, SHARD_ROWS):
            vec, at = shard.column(0).to_numpy(), shard.column(1)
            lengths = np.diff(at.offsets.to_numpy())
            width = max(q.shape[1], int(lengths.max(initial=0)), 1)
            x = matrix(at, width)
            # Equal rows stand together after the sort: one of them is scored for all.
            new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]) if len(x) > 1 else np.ones(len(x), bool)
            start, x = np.flatnonzero(new), x[new]
            many = np.diff(np.concatenate([start, [len(vec)]]))
            kind = held_as(q, x)
            x = x.astype(kind)
            for i in range(0, len(q), _TOGETHER):
                part = np.zeros((min(_TOGETHER, len(q) - i), width), kind)
                part[:, : q.shape[1]] = q[i : i + _TOGETHER]
                # A floor below every possible sum is none; so it fits the type.
                limit = np.maximum(best.floor[i : i + _TOGETHER], _LEAST[kind]).astype(kind)
                pq, px, score, _ = competing(part, x, limit)
                for j in range(0, len(pq), 1 << 20):
                    a, b, s = pq[j : j + (1 << 20)], px[j : j + (1 << 20)], score[j : j + (1 << 20)]
                    n = np.minimum(many[b], 1 << 20)
                    if n.size and n.max() > 1:
                        # Of equal rows at most k + 1 smallest ids can count, the query's own among them.
                        a, s, rows = _spread(a, b, s, start, many, vec, k)
                    else:
                        rows = vec[start[b]]
                    best.add(a + i, rows, s)
        best.settle()
        for i in range(0, len(best.query), 65536):
            of = slice(i, i + 65536)
            at = best.query[of]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(hashes[at]), pa.array(best.id[of]), pa.array(best.score[of])], names=["query_id", "query_hash", "vec_id", "score"])

    return run


def _spread(query, row, score, start, many, vec, k):
    """Pairs with a group of equal rows to pairs with those of its rows that can be among the k best: the k + 1 smallest other ids."""
    a, s, ids = [], [], []
    for r in np.unique(row[many[row] > 1]):
        own = np.sort(vec[start[r] : start[r] + many[r]])
        few = own[:0]
        # Repeated ids count as rows, but a query's own id may stand any number of times before the others.
        values, counts = np.unique(own, return_counts=True)
        few = np.repeat(values, np.minimum(counts, k))[: 2 * k + 1]
        at = np.flatnonzero(row == r)
        a.append(np.repeat(query[at], len(few)))
        s.append(np.repeat(score[at], len(few)))
        ids.append(np.tile(few, len(at)))
    single = many[row] == 1
    return np.concatenate([query[single], *a]), np.concatenate([score[single], *s]), np.concatenate([vec[start[row[single]]], *ids])


def first_floors(sample, k: int):
    """A map over queries (vec_id, h, v) that adds floor: the k-th best score among the sampled candidates, the least long if these are too few."""

    def run(batches):
        ids, x = sample.value
        for b in batches:
            width = max(x.shape[1], int(np.diff(b.column(2).offsets.to_numpy()).max(initial=0)))
            q = matrix(b.column(2), width)
            kind = held_as(q, x)
            wide = np.zeros((len(x), width), kind)
            wide[:, : x.shape[1]] = x
            floor = np.full(len(q), np.iinfo(np.int64).min)
            for i in range(0, len(q), _TOGETHER):
                got = q[i : i + _TOGETHER].astype(kind) @ wide.T
                other = b.column(0).to_numpy()[i : i + _TOGETHER, None] != ids[None, :]
                got = np.where(other, got, np.iinfo(np.int64).min if kind == np.int64 else -np.inf)
                if got.shape[1] >= k:
                    kth = np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k]
                    floor[i : i + _TOGETHER] = np.where(other.sum(axis=1) >= k, kth, np.iinfo(np.int64).min).astype(np.int64) if kind == np.int64 else np.where(np.isfinite(kth), kth, float(np.iinfo(np.int64).min)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], names=["vec_id", "h", "v", "floor"])

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score of its k best among all others."""
    spark = vectors.sparkSession
    stash = Stash(spark)
    v, limit = F.col(vector_col), F.lit(float("inf"))
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < limit) & ~F.isnan(x), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    lead = lambda c: F.expr(f"array_position(v, {c})")
    rows = rows.withColumn("h", F.xxhash64("vec_id", "v")).sortWithinPartitions(lead("array_max(v)"), lead("array_min(v)"), "v", "vec_id")
    rows = stash(rows)
    n_queries, width = rows.where(F.col("vec_id") % every == 0).agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).head()
    blocks = max(1, -(-n_queries * max(width, 1) // BLOCK_VALUES))
    few = rows.orderBy(F.xxhash64("h"), "vec_id").limit(SAMPLE_ROWS).select("vec_id", "v").toArrow()
    at = few.column("v").combine_chunks()
    at = at if isinstance(at, pa.Array) else pa.concat_arrays(at.chunks)
    sample = spark.sparkContext.broadcast((few.column("vec_id").to_numpy(), matrix(at, max([1, *np.diff(at.offsets.to_numpy())]))))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h"]).select("vec_id", "h", "v")
    asked = stash(asked.mapInArrow(first_floors(sample, k), "vec_id long, h long, v array<long>, floor long").withColumn("block", F.pmod(F.xxhash64("h", "vec_id"), F.lit(blocks)).cast("int")), partition_by="block")
    found = None
    for no in range(blocks):
        t = asked.where(F.col("block") == no).select("vec_id", "h", "v", "floor").orderBy("vec_id", "h").toArrow()
        if not t.num_rows:
            continue
        b = t.combine_chunks().to_batches()[0]
        q = matrix(b.column(2), max(width, 1))
        block = spark.sparkContext.broadcast((b.column(0).to_numpy(), b.column(1).to_numpy(), q, b.column(3).to_numpy()))
        part = rows.select("vec_id", "v").mapInArrow(searcher(block, k), _FOUND)
        part = stash(part) if blocks > 1 else part  # a block's copy leaves the executors before the next
        found = part if found is None else found.unionAll(part)
        if blocks > 1:
            block.unpersist()
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
