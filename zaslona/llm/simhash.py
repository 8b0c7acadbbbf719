"""SimHash near-duplicate groups by ball hashing.

A fingerprint has 64 bits; two link at ``radius`` (at most 5) or fewer differing bits. One 32-bit half of such a
pair then differs in at most two bits. Every distinct fingerprint therefore emits, for each half, all variants within
half that distance (the half itself and its 32 one-bit flips): the balls of linked fingerprints meet in a variant.
Variants are shuffled, and the fingerprints that collide are verified on all 64 bits. Balls over the whole fingerprint
would be 2081 variants, eight times the text itself; balls over halves are 66.

Defined results: a null or blank text has fingerprint zero and links like any other; rows with a null id keep their
row and never name a component unless all of its ids are null; repeated rows are kept; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, components, sliced

#: Members of one variant that a task links in memory, at a cost of their square. Larger ones are dealt anew by balls over the other half.
RUN_MAX = 1 << 13
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts, k = [0, *ends[:-1]], min(shingle, len(words))
    ends, n, digest = ends[k - 1 :], len(words) - k + 1, xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = b"".join([digest(flat[a : b - 1], 42) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, shingle: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and fp, a signed long."""

    @F.pandas_udf("long")
    def fp(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(*keep, fp(F.col(text)).alias("fp"))


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: pairs (member, root)."""
    out, left = [], np.unique(x)
    while left.size > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and left.size:
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out += [(y, root) for y in found]
                todo += list(found)
    return out


def linker(radius: int, run_max: int):
    """A map over (key, fp) batches sorted by key: edges (0, member, root); rows (1, key, fp) of runs too large to hold."""

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def run(batches):
        key, held, size, over = None, [], 0, False

        def close():
            if size > 1 and not over:
                pairs = forest(np.concatenate(held).view(np.uint64), radius)
                if pairs:
                    p = np.array(pairs, np.uint64).view(np.int64)
                    yield rows(0, p[:, 0].copy(), p[:, 1].copy())

        for batch in batches:
            k, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            cuts = np.concatenate([[0], cuts, [len(k)]])
            inner = np.flatnonzero(np.diff(cuts) > 1)
            wanted = sorted({0, len(cuts) - 2, *inner.tolist()})  # single rows inside a batch link to nothing
            for j in wanted:
                a, b = cuts[j], cuts[j + 1]
                if k[a] != key:
                    yield from close()
                    key, held, size, over = k[a], [], 0, False
                size += b - a
                if over:
                    yield rows(1, k[a:b].copy(), f[a:b].copy())
                    continue
                held.append(f[a:b].copy())
                if size > run_max:
                    over, every = True, np.concatenate(held)
                    held = []
                    yield rows(1, np.full(len(every), key, np.int64), every)
        yield from close()

    return run


def edges(fps: DataFrame, stash: Stash, radius: int = 4, run_max: int = RUN_MAX) -> DataFrame:
    """Edges (u, v) among distinct fingerprints fp whose components are those of all links."""
    if not 0 <= radius <= 5:
        raise ValueError("radius must be 0 to 5")
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = [0, *(1 << i for i in range(32))]
    keys = [hi.bitwiseXOR(F.lit(m).cast("long")) for m in flips] + [lo.bitwiseXOR(F.lit(m).cast("long")) + F.lit(1 << 32) for m in flips]

    def linked(df: DataFrame, most: int) -> DataFrame:
        return stash(df.repartition("key").sortWithinPartitions("key").mapInArrow(linker(radius, most), "kind int, a long, b long"), batch_rows=65536)

    first = linked(fps.select(F.explode(F.array(*keys)).alias("key"), "fp"), run_max)
    found = first.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    held = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if held.isEmpty():
        return found
    # A crowded variant: its members also agree nearly in the other half, so in one of that half's quarters they
    # differ in at most two bits; the same balls over 16-bit quarters leave runs of at most 33 * 17 * 2**16 members.
    other = F.when(F.col("key") < F.lit(1 << 32), lo).otherwise(hi)
    parts = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16) + F.lit(1 << 16)]
    sub = [F.col("key") * F.lit(1 << 17) + p.bitwiseXOR(F.lit(m).cast("long")) for p in parts for m in [0, *(1 << i for i in range(16))]]
    second = linked(held.select(F.explode(F.array(*sub)).alias("key"), "fp"), 1 << 62)
    return found.unionAll(second.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, keep: list[str] | None = None, run_max: int = RUN_MAX) -> DataFrame:
    """One row per document: ``id_col``, the columns ``keep``, fp (long) and component_id (the smallest id reachable by links)."""
    stash = Stash(docs.sparkSession)
    marked = stash(with_fingerprint(docs, text_col, shingle, list(dict.fromkeys([id_col, *(keep or [])]))))
    nodes = stash(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(edges(nodes.select("fp"), stash, radius, run_max), stash)
    owned = nodes.join(roots, nodes.fp == roots.u, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    named = owned.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(*marked.columns, "component_id")


# Near duplicates by exact similarity: the sets of word shingles of two texts have a Jaccard similarity of 0.8 or more.
# Shingles have one total order, those rare in a sample of the documents first. Of two such sets the beginnings (a
# fifth of each, and one more) share a shingle in any order, so only beginnings are shuffled. The sample only changes
# the order and so the cost, not the result. What meets at a shingle and can still reach 0.8 by size and place is a
# pair, if the sets' fingerprints agree: SimHashes of 256 bits, of which such sets differ in 39 to 48 on average and
# hardly ever in more than ``APART``, and unrelated ones in 128. At a shingle where more than ``CROWD`` sets meet, these
# are dealt into bands of size and linked by fingerprint alone, so that their pairs never become rows. The whole sets
# of each chain of candidates are then brought together once and linked by their similarity.

#: Bits in which the fingerprints of like sets may differ. At 0.8 their number has a mean of at most 48 and a standard
#: deviation below 6.5, so a pair is missed with a chance below one in a thousand million.
APART = 90
CROWD = 16
SETS_MAX = 2048
_SAMPLE, _SAMPLED = 32, 200_000


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, in order; a text shorter than a shingle is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts, k = [0, *ends[:-1]], min(shingle, len(words))
    ends, digest = ends[k - 1 :], xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(flat[a : b - 1], 42) for a, b in zip(starts, ends)]), np.uint64))


def enough(shared, n, m):
    """Whether sets of n and m members that share so many have a similarity of 0.8 or more."""
    return 9 * shared >= 4 * (n + m)


def beginning(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first members of a set that a set as like as 0.8 cannot all lack; common is sorted and has counts."""
    n = len(s)
    if not n:
        return s
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))][: n - (4 * n + 4) // 5 + 1]


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets: pairs of places (member, root)."""
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    cuts = np.cumsum(size)[:-1]
    own = np.split(flat, cuts)
    out, left, todo, root = [], np.arange(len(sets)), [], -1
    mark = np.zeros(len(words), np.int32)
    while left.size:
        if not todo:
            root, left = left[0], left[1:]
            todo, starts = [root], None
            if not left.size:
                break
        if starts is None:
            rows = np.concatenate([own[i] for i in left])
            starts = np.concatenate([[0], np.cumsum(size[left])[:-1]])
        y = todo.pop()
        mark[own[y]] = 1
        near = enough(np.add.reduceat(mark[rows], starts), size[left], size[y])
        mark[own[y]] = 0
        if near.any():
            found, left, starts = left[near], left[~near], None
            out += [(z, root) for z in found]
            todo += list(found)
    return out


def _links(kind: int, *columns: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["kind", *"abcd"[: len(columns)]])


def meet(crowd: int):
    """A map over (key, node, n, at) sorted by key: pairs (0, node, node) that may link; rows (1, key, node) of keys with more than crowd nodes."""

    def run(batches):
        held, over = np.zeros((4, 0), np.int64), None

        def pairs(x):
            for s in range(1, crowd):
                p, q = x[:, :-s], x[:, s:]
                bound = np.minimum(p[2] - p[3], q[2] - q[3])
                ok = (p[0] == q[0]) & enough(bound, p[2], q[2])
                if ok.any():
                    yield _links(0, np.maximum(p[1], q[1])[ok], np.minimum(p[1], q[1])[ok])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if over is not None:
                more = x[0] == over
                if more.any():
                    yield _links(1, x[0, more], x[1, more])
                    x = x[:, ~more]
                if x.shape[1]:
                    over = None
                else:
                    held = x
                    continue
            cuts = np.flatnonzero(np.diff(x[0])) + 1
            sizes = np.diff(np.concatenate([[0], cuts, [x.shape[1]]]))
            each = np.repeat(sizes, sizes)
            full = each > crowd
            if full.any():
                yield _links(1, x[0, full], x[1, full])
            last = x.shape[1] - sizes[-1]
            held = x[:, :0]
            if sizes[-1] > crowd:
                over = x[0, -1]
            else:
                held = x[:, last:].copy()
                full[last:] = True
            few = ~full & (each > 1)
            yield from pairs(x[:, few])
        yield from pairs(held)

    return run


_TOKEN = np.dtype("u1,<u4")  # 40 bits of a shingle's hash, for comparing sets


def packed(s: np.ndarray) -> bytes:
    out = np.empty(len(s), _TOKEN)
    out["f0"], out["f1"] = (s >> np.uint64(56)).astype(np.uint8), ((s >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, _TOKEN)
    return (x["f0"].astype(np.uint64) << np.uint64(32)) | x["f1"]


def wide(s: np.ndarray) -> bytes:
    """The SimHash of 256 bits of a set of 64-bit hashes."""
    ones = np.zeros(256, np.int64)
    for i in range(0, len(s), _BLOCK // 4):
        part = s[i : i + _BLOCK // 4]
        mixed = np.stack([(part ^ (part >> np.uint64(29))) * np.uint64(m) for m in _MULTIPLIERS], axis=1)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_MULTIPLIERS[0])
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(s)).tobytes()


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def kin(fps: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the sets whose fingerprints (rows of four words) and sizes let them be alike: pairs of places."""
    out, left = [], np.arange(len(size))
    while left.size > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and left.size:
            y = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[y]).sum(axis=1, dtype=np.int64) <= APART
            near &= (5 * size[left] >= 4 * size[y]) & (5 * size[y] >= 4 * size[left])
            if near.any():
                found, left = left[near], left[~near]
                out += [(z, root) for z in found]
                todo += list(found)
    return out


def crowded(batches):
    """A map over (key, x, y, node, n, fp) sorted by the first three: links (0, member, root) that chain each group's kin."""
    now, held = None, []

    def close():
        if len(held) > 1:
            node, n = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
            fps = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(-1, 4)
            node, first = np.unique(node, return_index=True)
            p = np.array(kin(fps[first], n[first]), np.int64).reshape(-1, 2)
            if len(p):
                yield _links(0, node[p[:, 0]], node[p[:, 1]])

    for batch in batches:
        for *k, node, n, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if k != now:
                yield from close()
                now, held = k, []
            held.append((node, n, fp))
    yield from close()


def gathered(batches):
    """A map over (key, x, y, node, tokens) sorted by the first three: links (0, member, root) among the sets of each."""
    now, nodes, sets = None, [], []

    def close():
        if len(nodes) > 1:
            p = np.array(alike(sets), np.int64).reshape(-1, 2)
            if len(p):
                at = np.array(nodes, np.int64)
                yield _links(0, at[p[:, 0]], at[p[:, 1]])

    for batch in batches:
        keys, nums, tokens = list(zip(*(c.to_pylist() for c in batch.columns[:3]))), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for k, node, t in zip(keys, nums, tokens):
            if k != now:
                yield from close()
                now, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(unpacked(t))
    yield from close()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, run_max: int = SETS_MAX) -> DataFrame:
    """One row per document: the id, text_hash and component_id, the smallest id among its near duplicates' chain."""
    spark = docs.sparkSession
    stash = Stash(spark)
    import pandas as pd

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))

    @F.pandas_udf("array<long>")
    def tokens(texts):
        return pd.Series([shingles(t, shingle).view(np.int64) for t in texts], dtype=object)

    seen = src.where(F.pmod("text_hash", F.lit(_SAMPLE)) == 0).dropDuplicates(["text_hash"]).select(F.explode(tokens("text")).alias("t")).groupBy("t").count().where("count > 1")
    often = seen.orderBy(F.desc("count"), "t").limit(_SAMPLED).collect()
    common = np.array([r[0] for r in often], np.int64).view(np.uint64)
    counts = np.array([r[1] for r in often], np.int64)
    order = np.argsort(common)
    common, counts = common[order], counts[order]

    def begun(batches):
        for batch in batches:
            every = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            first = [beginning(s, common, counts).view(np.int64) for s in every]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in every], np.uint64).view(np.int64)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *first]))
            cols = [batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in every], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array([wide(s) for s in every], pa.binary()), pa.array([packed(s) for s in every], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text_hash", "node", "n", "first", "fp", "tokens"])

    marked = stash(src.select(F.col("id").cast("long").alias("id"), "text_hash", "text").mapInArrow(sliced(begun), "id long, text_hash long, node long, n long, first array<long>, fp binary, tokens binary"))
    # Sets are told apart by a 64-bit hash; the smallest id stands for its copies.
    nodes = stash(marked.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "first", "fp"))))
    begins = nodes.select(F.posexplode("first").alias("at", "key"), "node", "n").select("key", "node", "n", F.col("at").cast("long").alias("at"))
    met = stash(begins.repartition("key").sortWithinPartitions("key").mapInArrow(meet(min(CROWD, run_max)), "kind int, a long, b long"), batch_rows=65536)
    stash.free()
    prints = nodes.select("node", "n", "fp")
    pairs = met.where("kind = 0").select("a", "b").distinct()
    pairs = pairs.join(prints.select(F.col("node").alias("a"), F.col("fp").alias("p")), "a").join(prints.select(F.col("node").alias("b"), F.col("fp").alias("q")), "b")
    word = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
    differ = sum((F.bit_count(word("p", i).bitwiseXOR(word("q", i))) for i in range(4)), F.lit(0))
    pairs = stash(pairs.where(differ <= APART).select(F.col("a").alias("u"), F.col("b").alias("v")))
    # The sets that crowd at a shingle, by size: like sets are in one band or in two neighbouring ones, and each set
    # goes to its own band and the next.
    crowd = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node")).join(prints, "node")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.25)))).cast("long")
    cells = crowd.select(F.explode(F.array(band, band + 1)).alias("band"), "key", "node", "n", "fp").select(F.xxhash64("key", "band").alias("key"), "node", "n", "fp")
    near = stash(dealt(cells, run_max).mapInArrow(crowded, "kind int, a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    stash.free()
    # The sets of a chain of candidates are brought together once, not for every pair.
    chains = components(pairs.unionAll(near), stash)
    for table in (met, pairs, near):
        stash.drop(table)
    group = stash(chains.select(F.col("root").alias("key"), F.col("u").alias("node")).unionAll(chains.select("root", "root").distinct()))
    sets = marked.select("node", "tokens").join(group, "node").dropDuplicates(["node"]).select("key", "node", "tokens")
    found = stash(dealt(sets, run_max).mapInArrow(gathered, "kind int, a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")))
    stash.free()
    stash.drop(group)
    roots = components(found, stash)
    owned = nodes.join(roots, nodes.node == roots.u, "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    lowest = owned.groupBy("root").agg(F.min("id").alias("component_id"))
    named = owned.join(lowest, "root").select("node", "component_id")
    out = stash(marked.select("id", "text_hash", "node").join(named, "node", "left").select(F.col("id").alias(id_col), "text_hash", "component_id"))
    stash.drop(marked)
    stash.drop(nodes)
    stash.free()
    return out


def dealt(rows: DataFrame, run_max: int) -> DataFrame:
    """Rows (key, node, ...) as sorted groups (key, x, y, node, ...).

    Blocks of a large group are dealt out in pairs: any two rows share a pair, and no task holds more than two blocks.
    """
    n = rows.groupBy("key").agg(F.ceil(F.count("*") / run_max).cast("int").alias("blocks"))
    block = rows.join(n, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = [c for c in rows.columns if c != "key"]
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    by = ["key", "x", "y"]
    return block.select("key", *rest, F.explode(pairs).alias("p")).select("key", "p.x", "p.y", *rest).repartition(*by).sortWithinPartitions(*by)
