"""Importance resampling of documents towards a target set.

Runs of one to ``max_n`` words fall into ``buckets`` by their crc32. The documents' and the target's counts by bucket
give each bucket a gain, an array that every task scores its documents with; a document's weight is the mean gain of
its features, and its score adds Gumbel noise from a hash of its id, so that the highest scores are a draw by weight
without replacement.

Scored documents are written as sorted runs, one a task. A histogram of the eligible scores gives the score at which
the draw ends. What lies at or above it is dealt out by ranges of (score, id); each task cuts what it gets into sorted
runs, as they come from the files, and merges them by a tournament tree, stopping once the last score's share is
drawn. Parts follow each other, so that a rank is a place in a part and the sizes of the parts before it.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as an empty one and comes
after the others of its score; repeated rows are drawn each for itself, equal ones in any order; no eligible documents
or a draw of none give null ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, sliced

#: Bytes of text whose words are taken at once, and rows that one task merges on average.
BLOCK, MERGED = 1 << 20, 200_000
_WORD = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
_SHORT = 64


def _stepped(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """States after as many zero bytes as the table stands for."""
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For 0 to _SHORT zero bytes, and for powers of two of them, what each byte of a crc32 turns into."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = (byte >> 1) ^ (np.uint32(0xEDB88320) * (byte & 1))
    own = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    short = [own]
    for _ in range(_SHORT):
        short.append(byte[short[-1] & 255] ^ (short[-1] >> 8))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_stepped(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


_BY_LENGTH, _BY_POWER = _tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 values carried over so many more bytes: the crc of a joined text is this of its first part, xor the second's crc."""
    n = np.minimum(lengths, _SHORT)
    out = _BY_LENGTH[n, 0, crc & 255] ^ _BY_LENGTH[n, 1, (crc >> 8) & 255] ^ _BY_LENGTH[n, 2, (crc >> 16) & 255] ^ _BY_LENGTH[n, 3, crc >> 24]
    for i in np.flatnonzero(lengths > _SHORT):
        state, left = crc[i : i + 1], int(lengths[i])
        for k in range(left.bit_length()):
            if left >> k & 1:
                state = _stepped(state, _BY_POWER[k])
        out[i] = state[0]
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Words of texts in blocks: places of texts and their words. A long text comes in several blocks, cut between words."""
    who, words, size = [], [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass").translate(_FOLD)
        at = 0
        while at < len(data):
            cut = len(data)
            if cut - at > BLOCK:
                cut = data.rfind(b" ", at, at + BLOCK)
                cut = cut if cut > at else data.find(b" ", at + BLOCK)
                cut = cut if cut > at else len(data)
            who.append(i)
            words.append(data[at:cut].split())
            size, at = size + cut - at, cut
            if size >= BLOCK:
                yield who, words
                who, words, size = [], [], 0
    if who:
        yield who, words


def features(texts: list[str | None], max_n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of all runs of 1 to ``max_n`` words: the texts they stand in and their buckets, with their number of words."""
    space = np.uint32(zlib.crc32(b" "))
    held = None  # owners, crcs and lengths of the last words of the block before
    for who, words in _blocks(texts):
        counts = [len(w) for w in words]
        flat = [w for x in words for w in x]
        own = np.repeat(np.array(who, np.int64), counts)
        crc = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        new = 0
        if held is not None and max_n > 1:
            own, crc, size, new = np.concatenate([held[0], own]), np.concatenate([held[1], crc]), np.concatenate([held[2], size]), len(held[0])
        yield own[new:], (crc[new:] % np.uint32(buckets)).astype(np.int64), 1
        spaced = crc ^ shifted(np.full(len(crc), space, np.uint32), size)  # of a space and the word
        run = crc
        for n in range(2, max_n + 1):
            if len(own) < n:
                break
            # Runs of n words, by their last one: what n - 1 words gave, and a space and one word more.
            run = shifted(run[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
            ok = own[n - 1 :] == own[: len(own) - n + 1]
            ok[: max(0, new - n + 1)] = False  # wholly within what came before
            yield own[n - 1 :][ok], (run[ok] % np.uint32(buckets)).astype(np.int64), n
        held = tuple(x[max(0, len(own) - max_n + 1) :] for x in (own, crc, size))


def bucket_counts(docs: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, found, _ in features(b.column(0).to_pylist(), max_n, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(sliced(count), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, from counts with one added."""
    m, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + m) / ((float(a) + 1) * (t + m)))) for a, b in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the id's hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight and score."""
    spark = docs.sparkSession
    array = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets)))

    def score(batches):
        for b in batches:
            ids, n = b.column(0).to_pylist(), b.num_rows
            words, many, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for own, found, size in features(b.column(1).to_pylist(), max_n, buckets):
                here = np.bincount(own, minlength=n)
                many += here
                if size == 1:
                    words += here
                total += np.bincount(own, array.value[found], minlength=n).astype(np.int64)
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            value = weight + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, many, weight, value))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(sliced(score), "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


class Tournament:
    """Merges sorted runs: a tree of matches, in which a winner's next row meets only those that lost to it on its way up."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        # Nodes hold the loser of their match; 0 holds the winner of all. Empty places lose every match.
        self.tree, self.size = [-1] * size, size
        won = [i if i < len(runs) else -1 for i in range(size)]
        node = size
        while len(won) > 1:
            node //= 2
            pairs = [self._match(won[i], won[i + 1]) for i in range(0, len(won), 2)]
            self.tree[node : 2 * node] = [p[1] for p in pairs]
            won = [p[0] for p in pairs]
        self.winner = won[0]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return b, a
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return a, b
        return (a, b) if self.runs[a][self.at[a]] <= self.runs[b][self.at[b]] else (b, a)

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            top = self.winner
            yield self.runs[top][self.at[top]]
            self.at[top] += 1
            node = (top + self.size) // 2
            while node:
                top, self.tree[node] = self._match(top, self.tree[node])
                node //= 2
            self.winner = top


def natural_runs(keys: list) -> list[list]:
    """A list cut where it does not ascend."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [keys[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def _merge(last: int, left: int) -> Callable:
    """A map over a part's rows that puts them in order; of the last score ``left`` rows get a place at most."""

    def run(batches):
        keys = []
        for b in batches:
            doc, words, many, weight, score = (b.column(i).to_pylist() for i in range(5))
            keys += [(-s, d is None, d or 0, f, n, w) for d, n, f, w, s in zip(doc, words, many, weight, score)]
        part, taken, rows = TaskContext.get().partitionId(), 0, []
        merged = Tournament(natural_runs(keys)) if keys else None
        if merged:
            for key in merged:
                if key[0] == -last:
                    taken += 1
                    if taken > left:
                        break
                rows.append(key)
            else:
                merged = None
        drawn = len(rows)
        if merged:  # the draw has ended here: what is left in the runs gets no place
            rows.append(key)
            merged.at[merged.winner] += 1
            rows += [k for r, at in zip(merged.runs, merged.at) for k in r[at:]]
        for i in range(0, len(rows), 10_000):
            some = rows[i : i + 10_000]
            columns = [[part] * len(some), [j + 1 if j < drawn else None for j in range(i, i + len(some))], [None if k[1] else k[2] for k in some], [k[3] for k in some], [k[5] for k in some], [-k[0] for k in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 5))], names=["part", "place", "doc_id", "n_features", "weight", "score"])

    return run


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, merged_rows: int = MERGED, **options) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down) get ranks from 1 in
    order of score, ties by smaller id; the rest has null. ``options`` are those of ``scored``.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    every = stash(scored(docs, target, **options).sortWithinPartitions(*order))
    fit = F.col("n_words") >= min_words
    # Scores are thousandths of logarithms: some tens of thousands of values, whatever the number of documents.
    counts = sorted(((r["score"], r["n"]) for r in every.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, above, last = sum(n for _, n in counts) * percent // 100, 0, None
    for value, n in counts:
        if wanted and above + n >= wanted:
            last = value
            break
        above += n
    empty = F.lit(None).cast("long").alias("rank")
    if last is None:
        return every.select("doc_id", "n_features", "weight", "score", empty)
    near = fit & (F.col("score") >= last)
    tasks = -(-(above + n) // merged_rows)
    dealt = every.where(near).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(tasks, *order, F.col("at"))
    merged = stash(dealt.select("doc_id", "n_words", "n_features", "weight", "score").mapInArrow(_merge(last, wanted - above), "part int, place bigint, doc_id bigint, n_features bigint, weight bigint, score bigint"))
    bases, base = [], 0
    for r in merged.groupBy("part").agg(F.count("place").alias("n")).orderBy("part").collect():  # a row a merging task
        bases.append((r["part"], base))
        base += r["n"]
    rank = F.col("base") + F.col("place")
    ranked = merged.join(F.broadcast(spark.createDataFrame(bases, "part int, base bigint")), "part")
    ranked = ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= wanted, rank).alias("rank"))
    return every.where(~near).select("doc_id", "n_features", "weight", "score", empty).unionByName(ranked)
