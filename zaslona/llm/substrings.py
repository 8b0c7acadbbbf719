"""Exact removal of repeated 50-byte strings, by ranks of growing length over sampled positions.

Prefix doubling ranks positions by strings of growing length and drops a position once its rank is unique. One row
for each byte and round would be forty times the text, so four things keep it small, none of which changes a result:

* Positions are sampled by content: of the 35 strings of 16 bytes within a string of 50, the one of least hash is its
  anchor. Equal strings have equal anchors, so only about one position in eighteen is ranked.
* A text that a smaller id holds word for word loses all of it, if it has 50 bytes; only one document of each text goes
  through the rounds.
* Round 1 ranks anchors by their 16 bytes. Documents send these ranks to partitions of the rank space, packed by batch;
  each partition sorts its ranks and sends back those that two texts share, packed by shard of documents. All other
  anchors leave.
* What is left is ranked by the pair of that rank and the rank of the 84 bytes around it, which hold every string of 50
  with this anchor. An anchor whose pair a smaller document has is settled for all its strings. Of each other pair one
  representative goes on.
* Round 2 doubles the length: the strings of an anchor fall into two sides, whose strings share 34 and 33 bytes, and a
  side leaves whose longer rank no other document has.
* Round 3 sorts what is left by longer rank and id over all tasks, and ranks the strings by the pair of their ranks of
  25 bytes at offsets 0 and 25. Rows are taken in blocks of fixed size. Strings of a group that ends within a block are
  settled there; those of the groups at a block's two ends are settled by an aggregate over all blocks, whatever the
  size of the group, so none ever has to be held by one task.

Ranks are 64-bit hashes (pairs: 128 bits) in place of ordinals, which would need all rows in one order.

Defined results: a null text counts as empty; texts under 50 bytes lose nothing; rows with a null id lose nothing and
are no source; rows of one id are no source for each other, and equal ones get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, sliced
from .runs import _M, _powers, mixed

LENGTH, GRAM = 50, 16
_HALF = LENGTH // 2
_SPAN = LENGTH - GRAM + 1  # places of the anchor in a string
_LEFT, _RIGHT = _SPAN - 1, LENGTH  # what a context holds before the anchor, and from it on
#: The strings of an anchor, by where they start before it, in two halves.
SIDES = ((0, _SPAN // 2 - 1), (_SPAN // 2, _SPAN - 1))
#: Bytes of text for which there is one bucket of ranks, if the session has fewer shuffle partitions.
BUCKET_BYTES = 1 << 27
_PIECE = 1 << 20
_ROWS = 4096


def _rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes."""
    n = len(buf)
    up, down = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=c[1:])
    return mixed((c[width:] - c[:-width]) * down[: n - width + 1])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over all windows of ``width`` elements."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit ranks of a text's anchors."""
    at, rank = [], []
    for i in range(0, len(raw) - LENGTH + 1, _PIECE):
        # Strings that start in this piece; their anchors may lie beyond its end.
        buf = np.frombuffer(raw, np.uint8, min(len(raw) - i, _PIECE + LENGTH - 1), i)
        h = _rolling(buf, GRAM)
        least = _slide(h, _SPAN, np.minimum)
        edge = np.zeros(_SPAN - 1, np.uint64)
        found = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), _SPAN, np.maximum) == h)
        at.append(found + i)
        rank.append(h[found])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(at) == 1:
        return at[0], rank[0]
    p, first = np.unique(np.concatenate(at), return_index=True)
    return p, np.concatenate(rank)[first]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SHORT = np.dtype("u1,<u4")  # 40 bits of a rank


def _pack(buckets: int):
    """Batches of (doc, hash, text) to rows (bucket, docs, hashes, counts, ranks): per bucket the packed short ranks of each document."""

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            per = [np.unique(anchors(_bytes(t))[1]) for t in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(per)), [len(p) for p in per])
            if not len(row):
                continue
            rank = np.concatenate(per)
            bucket = (rank % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((row, bucket))
            rank, row, bucket = rank[order], row[order], bucket[order]
            low = (rank >> np.uint64(24)).astype(np.uint64)
            packed = np.empty(len(rank), _SHORT)
            packed["f0"], packed["f1"] = (low >> np.uint64(32)).astype(np.uint8), (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(rank)]):
                docs, counts = np.unique(row[a:b], return_counts=True)
                out.append((int(bucket[a]), ids[docs].astype(np.int64).tobytes(), hashes[docs].astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes(), packed[a:b].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "docs", "hashes", "counts", "ranks"])

    return run


def _shared(shards: int):
    """Of one partition's packed ranks those that two texts share: rows (shard, docs, counts, ranks), at most one for each shard of documents."""

    def run(batches):
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for b, ids, hashes, counts, ranks in zip(*(c.to_pylist() for c in batch.columns)):
                by_bucket.setdefault(b, []).append((ids, hashes, counts, ranks))
        for b in sorted(by_bucket):
            parts = by_bucket.pop(b)
            ids = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
            hashes = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
            counts = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts]).astype(np.int64)
            packed = np.concatenate([np.frombuffer(p[3], _SHORT) for p in parts])
            rank = (packed["f0"].astype(np.uint64) << np.uint64(32)) | packed["f1"]
            doc = np.repeat(np.arange(len(ids)), counts)
            order = np.argsort(rank, kind="stable")
            sorted_rank, text = rank[order], hashes[doc[order]]
            start = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
            many = np.minimum.reduceat(text, start) != np.maximum.reduceat(text, start)
            keep = np.zeros(len(rank), bool)
            keep[order] = np.repeat(many, np.diff(np.concatenate([start, [len(rank)]])))
            doc, packed = doc[keep], packed[keep]
            if not len(doc):
                continue
            shard = (ids.view(np.uint64) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard[doc], kind="stable")
            doc, packed = doc[order], packed[order]
            cuts = np.flatnonzero(np.diff(shard[doc])) + 1
            out = []
            for x, y in zip([0, *cuts], [*cuts, len(doc)]):
                first = np.flatnonzero(np.concatenate([[True], doc[x + 1 : y] != doc[x : y - 1]])) + x
                out.append((int(shard[doc[x]]), ids[doc[first]].tobytes(), np.diff(np.concatenate([first, [y]])).astype(np.uint32).tobytes(), packed[x:y].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", "docs", "counts", "ranks"])

    return run


def _by_document(batches):
    """One partition's rows (shard, docs, counts, ranks) to rows (doc, ranks), one for each document."""
    by_shard: dict[int, list] = {}
    for batch in batches:
        for s, ids, counts, ranks in zip(*(c.to_pylist() for c in batch.columns)):
            by_shard.setdefault(s, []).append((ids, counts, ranks))
    for s in sorted(by_shard):
        parts = by_shard.pop(s)
        ids = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
        counts = np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]).astype(np.int64)
        packed = np.concatenate([np.frombuffer(p[2], _SHORT) for p in parts])
        doc = np.repeat(ids, counts)
        order = np.argsort(doc, kind="stable")
        doc, packed = doc[order], packed[order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        ends = np.concatenate([first, [len(doc)]]).astype(np.int64) * _SHORT.itemsize
        for i in range(0, len(first), _ROWS):
            part = ends[i : i + _ROWS + 1]
            blobs = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer((part - part[0]).astype(np.int32)), pa.py_buffer(packed[part[0] // _SHORT.itemsize : part[-1] // _SHORT.itemsize].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(doc[first[i : i + _ROWS]]), blobs], names=["doc", "ranks"])


def _survivors(batches):
    """Texts with their shared ranks to rows (id, text_hash, at, rank, around, long0, long1), one for each surviving anchor.

    around ranks the bytes of its context and how many of them lie in the text; long0 and long1 rank the bytes that the
    strings of a side share, null where the text does not hold them. They only add to the 64 bits of rank, and whole
    strings are compared later, so 32 bits of each are enough.
    """
    for batch in batches:
        ids, hashes, texts, ranks = (c.to_pylist() for c in batch.columns)
        cols: list[list] = [[] for _ in range(9)]
        for d, h, text, blobs in zip(ids, hashes, texts, ranks):
            raw = _bytes(text)
            every, rank = anchors(raw)
            packed = np.frombuffer(blobs, _SHORT)
            wanted = (packed["f0"].astype(np.uint64) << np.uint64(32)) | packed["f1"]
            keep = np.isin(rank >> np.uint64(24), wanted)
            every, rank = every[keep], rank[keep]
            for i in range(0, len(raw), _PIECE):
                of = slice(*np.searchsorted(every, (i, i + _PIECE)))
                at = every[of]
                if not len(at):
                    continue
                begin = max(0, i - _LEFT)
                buf = np.frombuffer(raw, np.uint8, min(len(raw), i + _PIECE + _RIGHT) - begin, begin)
                up, down = _powers(len(buf) + 1)
                c = np.zeros(len(buf) + 1, np.uint64)
                np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=c[1:])
                left, right = np.minimum(at, _LEFT), np.minimum(len(raw) - at, _RIGHT)

                def ranked(back, ahead):
                    s, e = at - back - begin, at + ahead - begin
                    there = (s >= 0) & (e < len(c))
                    s, e = np.where(there, s, 0), np.where(there, e, 0)
                    return mixed((c[e] - c[s]) * down[s]), there

                around = mixed(ranked(left, right)[0] * np.uint64(_M) + (left * 64 + right).astype(np.uint64))
                for col, x in zip(cols, (np.full(len(at), d, np.int64), np.full(len(at), h, np.int64), at, rank[of].view(np.int64), around.view(np.int64))):
                    col.append(x)
                for k, (first, last) in enumerate(SIDES):
                    value, there = ranked(first, LENGTH - last)
                    cols[5 + 2 * k].append((value >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    cols[6 + 2 * k].append(~there)
        if cols[0]:
            arrays = [np.concatenate(c) for c in cols]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in arrays[:5]), pa.array(arrays[5], mask=arrays[6]), pa.array(arrays[7], mask=arrays[8])], names=["id", "text_hash", "at", "rank", "around", "long0", "long1"])


def _contexts(batches):
    """Texts with places (at, rank, around, sides) to rows (longer, side, low, rank, around, left, right, context)."""
    width, pad = _LEFT + _RIGHT, bytes(_LEFT + _RIGHT)
    for batch in batches:
        raws = [_bytes(t) for t in batch.column(1).to_pylist()]
        size = np.array([len(r) for r in raws])
        # A context may reach beyond the text: what it lacks is zero and counted in left and right.
        buf = np.frombuffer(pad + pad.join(raws) + pad, np.uint8)
        begin = width + np.cumsum(size + width) - size - width
        places = batch.column(2)
        own, text = places.flatten(), np.repeat(np.arange(len(raws)), places.value_lengths().to_numpy())
        at, sides = own.field("at").to_numpy(), own.field("sides")
        row, flat = np.repeat(np.arange(len(at)), sides.value_lengths().to_numpy()), sides.flatten()
        windows, low = np.lib.stride_tricks.sliding_window_view(buf, width), batch.column(0).to_numpy()
        for i in range(0, len(row), _ROWS):
            of = row[i : i + _ROWS]
            a, t = at[of], text[of]
            whole = windows[begin[t] + a - _LEFT]
            blobs = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32)), pa.py_buffer(whole.tobytes())])
            take, part = pa.array(of), flat.slice(i, _ROWS)
            left, right = np.minimum(a, _LEFT).astype(np.int32), np.minimum(size[t] - a, _RIGHT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.field("longer"), part.field("side"), pa.array(low[t]), own.field("rank").take(take), own.field("around").take(take), pa.array(left), pa.array(right), blobs], names=["longer", "side", "low", "rank", "around", "left", "right", "context"])


def _prefix_sums(context: np.ndarray) -> np.ndarray:
    n, w = context.shape
    c = np.zeros((n, w + 1), np.uint64)
    np.cumsum((context.astype(np.uint64) + np.uint64(1)) * _powers(w + 1)[0][:w], axis=1, out=c[:, 1:])
    return c


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _LEFT + _RIGHT)


def _between(sums: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hashes of bytes a to b of every context."""
    return mixed((sums[:, b] - sums[:, a]) * _powers(b + 1)[1][a])


def common(low: int, high: int) -> tuple[int, int]:
    """The bytes of a context that strings ``low`` to ``high`` share."""
    return _LEFT - low, _LEFT - high + LENGTH


def _strings(side: int, sums: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and rank of the strings of one side of each context."""
    rows, places, ranks = [], [], []
    for o in range(SIDES[side][0], SIDES[side][1] + 1):
        a, b = common(o, o)
        there = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        # Both halves of the string, ranked apart, are the rank of the whole.
        h = mixed(_between(sums, a, a + _HALF) * np.uint64(_M) + _between(sums, a + _HALF, b))
        rows.append(there)
        places.append(np.full(len(there), o, np.int64))
        ranks.append(h[there])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(ranks)


def _settle(batches):
    """Rows (longer, side, low, rank, around, left, right, context) sorted by the first and third to rows (kind, rank, around, low, bits, h).

    Kind 0: bit o of bits is set if a smaller id of the same batch has string o. Kind 1: a string, at place ``bits``,
    that may also stand in another batch, because its group reaches an end of this one.
    """
    for batch in batches:
        group, side, low, rank, around, left, right = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:7])
        sums, parts = _prefix_sums(_matrix(batch.column(7))), []
        for s in range(len(SIDES)):
            of = np.flatnonzero(side == s)
            r, o, h = _strings(s, sums[of], left[of], right[of])
            parts.append((of[r], o, h))
        row, o, h = (np.concatenate(c) for c in zip(*parts))
        if not len(row):
            continue
        number = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
        key = mixed(h * np.uint64(_M) + (number[row] * 64 + o).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least = np.empty(len(row), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(low[row][order], start), np.diff(np.concatenate([start, [len(row)]])))
        again = least < low[row]
        bits = np.zeros(len(rank), np.int64)
        np.bitwise_or.at(bits, row[again], np.int64(1) << o[again])
        hit = np.flatnonzero(bits)
        ends = (number[row] == 0) | (number[row] == number[-1])
        over = np.flatnonzero(ends & ~again)
        kind = np.concatenate([np.zeros(len(hit), np.int32), np.ones(len(over), np.int32)])
        at = np.concatenate([hit, row[over]])
        cols = (kind, rank[at], around[at], low[at], np.concatenate([bits[hit], o[over]]), np.concatenate([np.zeros(len(hit), np.int64), h[over].view(np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "rank", "around", "low", "bits", "h"])


def removed(n: int, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n bytes go. Bit o of an anchor's mask stands for the string that starts o bytes before the anchor."""
    row, o = np.nonzero((mask[:, None] >> np.arange(_SPAN)) & 1)
    start = at[row] - o
    start = start[(start >= 0) & (start + LENGTH <= n)]
    return np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(start + LENGTH, minlength=n + 1)[:n]) > 0


def spots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document that loses bytes: id, text_hash, spots (array of struct<at, mask>); and per text that several hold: text_hash, sha, low (the smallest id)."""
    spark = docs.sparkSession
    stash = Stash(spark)
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).where(F.octet_length("text") >= LENGTH)

    # A bucket of ranks is held by one task, so their number follows the bytes of text.
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), (src.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0) // BUCKET_BYTES)
    # Round 1 names a document by one hash; two that share it would only rank more than they need.
    doc = F.xxhash64("id", "text_hash").alias("doc")
    packed = src.select(doc, "text_hash", "text").mapInArrow(sliced(_pack(buckets)), "bucket int, docs binary, hashes binary, counts binary, ranks binary")
    sent = packed.repartition(buckets, "bucket").mapInArrow(_shared(buckets), "shard int, docs binary, counts binary, ranks binary")
    shared = stash(sent.repartition(buckets, "shard").mapInArrow(_by_document, "doc long, ranks binary"))
    stash.free()
    first = stash(src.groupBy("text_hash", F.sha2("text", 256).alias("sha")).agg(F.min("id").alias("id"), F.max("id").alias("high")))
    wanted = shared.join(first.select(doc), "doc", "left_semi")
    found = stash(src.withColumn("doc", doc).join(wanted, "doc").select("id", "text_hash", "text", "ranks").mapInArrow(sliced(_survivors), "id long, text_hash long, at long, rank long, around long, long0 int, long1 int"))
    stash.free()
    stash.drop(shared)
    # Of each pair the smallest id, and a place where it has it.
    of_least = [F.min_by(c, "id").alias(c) for c in ("text_hash", "at")]
    pairs = stash(found.groupBy("rank", "around").agg(F.min("id").alias("low"), F.max("id").alias("high"), *of_least, *(F.first(c).alias(c) for c in ("long0", "long1"))))
    stash.free()
    # Round 2 of the doubling: 34 and 33 bytes, those that the strings of one side of the anchor share.
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.xxhash64("rank", F.lit(i), f"long{i}").alias("longer"), F.col(f"long{i}").isNotNull().alias("there")) for i in range(len(SIDES))])
    longer = pairs.select("rank", "around", "low", "text_hash", "at", F.explode(sides).alias("s")).where("s.there").select("rank", "around", "low", "text_hash", "at", "s.side", "s.longer")
    # Each shuffle's files go before the next begins, since together they are the most that stands on disk at once.
    again = stash(longer.groupBy("longer").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").select("longer"))
    stash.free()
    left_over = stash(longer.join(again, "longer").select("low", "text_hash", "at", "rank", "around", "side", "longer"))
    stash.free()
    stash.drop(again)
    by_place = left_over.groupBy("low", "text_hash", "at", "rank", "around").agg(F.collect_list(F.struct("side", "longer")).alias("sides"))
    asked = stash(by_place.groupBy(F.col("low").alias("id"), "text_hash").agg(F.collect_list(F.struct("at", "rank", "around", "sides")).alias("places")))
    stash.free()
    stash.drop(left_over)
    # Round 3: all strings, next to those that share the longer rank.
    near = stash(src.join(asked, ["id", "text_hash"]).select("id", "text", "places").mapInArrow(sliced(_contexts), "longer long, side int, low long, rank long, around long, left int, right int, context binary"))
    stash.free()
    stash.drop(asked)
    settled = stash(near.repartitionByRange("longer", "low", "rank", "around").sortWithinPartitions("longer", "low").mapInArrow(sliced(_settle, _ROWS), "kind int, rank long, around long, low long, bits long, h long"), batch_rows=_ROWS)
    stash.free()
    stash.drop(near)
    strings = settled.where("kind = 1").select("rank", "around", "low", F.col("bits").alias("o"), "h")
    least = strings.groupBy("rank", "o", "h").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").drop("most")
    crossing = strings.join(least, ["rank", "o", "h"]).where("least < low").select("rank", "around", "low", F.expr("shiftleft(1L, cast(o as int))").alias("bits"))
    masks = settled.where("kind = 0").select("rank", "around", "low", "bits").unionAll(crossing).groupBy("rank", "around", "low").agg(F.bit_or("bits").alias("mask"))
    every = F.lit((1 << _SPAN) - 1)
    own = masks.select("rank", "around", F.col("low").alias("least"), "mask")
    known = pairs.where("high > low").select("rank", "around", F.col("low").alias("least"), F.lit(1).alias("full"))
    both = known.join(own, ["rank", "around", "least"], "full_outer").select("rank", "around", "least", F.coalesce("mask", F.lit(0)).alias("mask"))
    hit = found.select("id", "text_hash", "at", "rank", "around").join(both, ["rank", "around"]).select("id", "text_hash", "at", F.when(F.col("id") > F.col("least"), every).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    copies = first.where("high > id").select("text_hash", "sha", F.col("id").alias("low"))
    lost = stash(hit.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "mask")).alias("spots")))
    stash.free()
    for done in (settled, found, pairs):
        stash.drop(done)
    return lost, copies


def digest(raw: bytes, at: np.ndarray, mask: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans and the hash of what is left."""
    gone = removed(len(raw), at, mask)
    spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
    return len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans, kept_sha256."""
    found, copies = spots(docs, id_col, text_col)

    def measure(batches):
        for batch in batches:
            raws, found = [_bytes(t) for t in batch.column(1).to_pylist()], batch.column(2)
            sha = [hashlib.sha256(r).hexdigest() for r in raws]
            many = found.value_lengths().fill_null(0).to_numpy()
            ends, own = np.cumsum(many), found.flatten()
            at, mask = own.field("at").to_numpy(), own.field("mask").to_numpy()
            got = [digest(r, at[e - n : e], mask[e - n : e]) if n else (len(r), 0, 0, h) for r, n, e, h in zip(raws, many.tolist(), ends.tolist(), sha)]
            cols = list(zip(*got)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), batch.column(3), pa.array(sha, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_hash", "sha"])

    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    own = src.join(found, ["id", "text_hash"], "left").select("id", "text", "spots", "text_hash").mapInArrow(sliced(measure), schema + ", text_hash long, sha string")
    # A copy of a smaller id's text loses all of it; this join moves no text.
    whole = own.join(copies, ["text_hash", "sha"], "left").withColumn("all", F.coalesce(F.col(id_col) > F.col("low"), F.lit(False)) & (F.col("n_bytes") >= LENGTH))
    pick = lambda c, other: F.when(F.col("all"), other).otherwise(F.col(c)).alias(c)
    return whole.select(id_col, "n_bytes", pick("n_removed", F.col("n_bytes")), pick("n_spans", F.lit(1).cast("long")), pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
