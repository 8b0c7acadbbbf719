"""Quality classifier: random-indexing word vectors, pooled per document, and a calibrated two-layer network.

Every token falls into one of ``BUCKETS`` buckets by hash. A bucket's index vector is two signed ones at hashed places;
its word vector is the sum, over all its occurrences in all documents, of the index vectors of its two neighbours (the
left one's rotated). Tasks sum into tables of fixed size, which are added in two levels. A document's features are
the means of its word vectors, of their squares and of the products of neighbouring ones.

The network is fitted on at most ``max_train`` labelled documents (those of smallest hash), its temperature on a
fifth of them; everything else covers all documents.

Defined results: a null or empty text is scored from zero features; rows with a null id are scored and belong to
training, as their remainder is not 0, but carry no label; repeated rows are scored alike; several labels of one id
count as their largest; without labels of both classes every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Stash, sliced
from .runs import classes, hashes

BUCKETS, DIM = 1 << 14, 32
MAX_TRAIN = 20_000
_SEGMENTS, _SALTS = 16, 16
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_KINDS = classes(letters=_LETTERS, digits=_DIGITS, signs=bytes(set(range(33, 127)) - set(_LETTERS) - set(_DIGITS)))
_BLOCK = 1 << 15


def tokens(texts: list[str | None]) -> list[np.ndarray]:
    """Buckets of each text's tokens: runs of letters, of digits and of other signs. Bucket 0 stands for no neighbour."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return [(1 + h % np.uint64(BUCKETS - 1)).astype(np.int64) for h in hashes(raw, _KINDS)]


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors, two a bucket; bucket 0 has none."""
    h = np.arange(BUCKETS, dtype=np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    place = np.stack([h % DIM, (h >> np.uint64(8)) % DIM]).astype(np.int64)
    sign = np.stack([((h >> np.uint64(20)) & np.uint64(1)), ((h >> np.uint64(21)) & np.uint64(1))]).astype(np.float64) * 2 - 1
    sign[:, 0] = 0
    return place, sign


def neighbour_sums(ids: np.ndarray, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS * DIM)
    left, right = ids[:-1], ids[1:]
    for j in (0, 1):
        out += np.bincount(left * DIM + place[j][right], sign[j][right], BUCKETS * DIM)
        out += np.bincount(right * DIM + (place[j][left] + 1) % DIM, sign[j][left], BUCKETS * DIM)
    return out


def _count(batches):
    place, sign = _index()
    total, held, n = np.zeros(BUCKETS * DIM), [], 0
    for batch in batches:
        for ids in tokens(batch.column(0).to_pylist()):
            for i in range(0, len(ids), _BLOCK):
                held += [ids[max(0, i - 1) : i + _BLOCK], np.zeros(1, np.int64)]
                n += len(held[-2])
                if n >= 4 * _BLOCK:
                    total += neighbour_sums(np.concatenate(held), place, sign)
                    held, n = [], 0
    if held:
        total += neighbour_sums(np.concatenate(held), place, sign)
    salt = xxhash.xxh32_intdigest(total.tobytes()) % _SALTS
    parts = np.split(total, _SEGMENTS)
    yield pa.RecordBatch.from_arrays([pa.array(range(_SEGMENTS), pa.int32()), pa.array([salt] * _SEGMENTS, pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts])], names=["segment", "salt", "sums"])


def _add(batches):
    """Adds rows of one segment and salt."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for s, k, b in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(b, np.float32).astype(np.float64)
            sums[s, k] = sums[s, k] + x if (s, k) in sums else x
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].astype(np.float32).tobytes() for k in keys], pa.binary())], names=["segment", "salt", "sums"])


def word_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """The table of word vectors (BUCKETS x DIM, 2 MB): centred, of unit length."""
    schema = "segment int, salt int, sums binary"
    part = docs.select(text_col).mapInArrow(sliced(_count), schema)
    salted = part.repartition("segment", "salt").mapInArrow(_add, schema)
    rows = salted.withColumn("salt", F.lit(0)).repartition(_SEGMENTS, "segment").mapInArrow(_add, schema).collect()
    table = np.zeros((_SEGMENTS, BUCKETS // _SEGMENTS * DIM))
    for r in rows:
        table[r["segment"]] += np.frombuffer(r["sums"], np.float32)
    return unit_rows(table.reshape(BUCKETS, DIM))


def unit_rows(table: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(table, axis=1, keepdims=True)
    unit = table / np.maximum(size, 1e-9)
    used = size[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    return unit.astype(np.float32)


def pooled(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A document's features: means of vectors, squares and neighbours' products."""
    out, n = np.zeros((3, DIM)), len(ids)
    for i in range(0, n, _BLOCK):
        v = table[ids[i : i + _BLOCK + 1]]
        own = v[:_BLOCK]
        out[0] += own.sum(axis=0)
        out[1] += np.einsum("ij,ij->j", own, own)
        out[2] += np.einsum("ij,ij->j", v[:-1], v[1:])
    return (out / max(1, n)).astype(np.float32).ravel()


class Network:
    """Inputs, one hidden layer and a logistic unit whose logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.w = None
        if len(y) < 20 or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.dev
        order = rng.permutation(len(y))
        fit, tune = (order[len(y) // 5 :], order[: len(y) // 5])
        shapes = [(x.shape[1], hidden), (hidden,), (hidden,), ()]
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), shapes[0]), np.zeros(shapes[1]), rng.normal(0, 1 / np.sqrt(hidden), shapes[2]), np.zeros(())]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(epochs):
            rate = 0.003 * (1 - epoch / epochs) + 1e-5
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                a = np.tanh(x[part] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(a @ self.w[2] + self.w[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, self.w[2]) * (1 - a * a)
                grads, step = [x[part].T @ back + 1e-4 * self.w[0], back.sum(axis=0), a.T @ d, d.sum()], step + 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        z = self.logit(x[tune])
        heat = np.exp(np.linspace(-2, 3, 101))
        loss = [np.mean(np.logaddexp(0, z / t) - y[tune] * z / t) for t in heat]
        self.heat = float(heat[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit((x - self.mean) / self.dev) / self.heat, -500, 500)))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, columns: list[str] | None = None) -> DataFrame:
    """The documents (or their ``columns``) with held_out and score, in place of columns of these names."""
    import pandas as pd

    spark = docs.sparkSession
    stash = Stash(spark)
    table = spark.sparkContext.broadcast(word_vectors(docs, text_col))

    @F.pandas_udf("binary")
    def features(texts):
        return pd.Series([pooled(t, table.value).tobytes() for i in range(0, len(texts), BATCH_ROWS) for t in tokens(list(texts[i : i + BATCH_ROWS]))], dtype=object)

    keep = [c for c in (columns if columns is not None else docs.columns) if c not in ("held_out", "score", "__pool")]
    pools = stash(docs.select(*keep, features(F.col(text_col)).alias("__pool")))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("y")).where("__id is not null and y is not null").groupBy("__id").agg(F.max("y").cast("double").alias("y"))
    chosen = known.where(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    # A repeated id gives one row, so that the sample stays within its bound.
    rows = pools.select(F.col(id_col).alias("__id"), "__pool").join(F.broadcast(chosen), "__id").groupBy("__id", "y").agg(F.min("__pool").alias("p")).orderBy("__id").collect()
    x = np.array([np.frombuffer(r["p"], np.float32) for r in rows]).reshape(-1, 3 * DIM)
    net = spark.sparkContext.broadcast(Network(x.astype(np.float64), np.array([r["y"] for r in rows])))

    @F.pandas_udf("double")
    def score(pool):
        x = np.array([np.frombuffer(p, np.float32) for p in pool], np.float64).reshape(-1, 3 * DIM)
        return pd.Series(net.value.score(x))

    return pools.select(*keep, held_out(id_col).alias("held_out"), score("__pool").alias("score"))
