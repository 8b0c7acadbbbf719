"""Phrases of words that stand together, by hierarchical pair naming.

Frequent words get ids, for each language their own. From then on a phrase of k words is a pair of the ids of its first
and its last k - 1 words: positions where two neighbours both have a name are counted by pair over all texts, frequent
pairs are named in one table for all, and positions take the new name by a join with it. What is no part of a frequent
phrase leaves at once, since a phrase is at most as frequent as its parts. A name's pair is also its two parents: the
counts of all beginnings and ends are theirs and its own, which gives every cut, and a phrase lies within a longer one
exactly if it is a parent, a parent's parent and so on, of which the next longer ones are the most frequent.

Texts become segments of at most ``SEGMENT`` positions that overlap by the words a phrase may go on; each position is
counted in one segment. While a table of names is small (``broadcast_names``) tasks look names up in it; beyond that,
positions are joined with it by shuffles, in which Spark splits frequent keys.

Defined results: null and empty texts have no words; a null language counts as ``und``; repeated rows each count;
languages without a frequent phrase give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, sliced

#: Positions of a segment, distinct entries that a task holds before it passes them on, and names that are sent to all tasks.
#: A segment is one row of up to 12 bytes a position, of which readers, Arrow batches and groups hold many at once.
SEGMENT, HELD, BROADCAST = 1 << 12, 100_000, 500_000
#: Bytes of segments that a file's reader holds at once.
GROUP = 8 << 20
#: Bytes of a text whose words are taken at once, and of the texts of a batch.
BLOCK, TEXT = 1 << 20, 2 << 20
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in _BREAKS else 0x20 if c in b" \t" else c for c in range(256))
_SEQUENCE = "seg bigint, at binary, id binary"


def _tokens(text: str | None):
    """A text's words and breaks (a full stop, which no word holds) in blocks of about a megabyte."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\n", b" . ")
    at = 0
    while at < len(data):
        cut = len(data)
        if cut - at > BLOCK:
            cut = data.rfind(b" ", at, at + BLOCK)
            cut = cut if cut > at else data.find(b" ", at + BLOCK)
            cut = cut if cut > at else len(data)
        yield data[at:cut].split()
        at = cut


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, word, f) over all of docs' (lang, text); the row without a word has a language's number of words."""

    def count(batches):
        found: dict[str, Counter] = defaultdict(Counter)

        def rows():
            flat = []
            for lang, c in found.items():
                c.pop(b".", None)
                flat += [(lang, None, sum(c.values())), *((lang, w.decode("utf-8", "surrogatepass"), n) for w, n in c.items())]
            found.clear()
            for i in range(0, len(flat), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat[i : i + 50_000]), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "f"])

        long = 0  # bytes beyond what words usually take
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for words in _tokens(text):
                    found[lang].update(words)
                    long += max(0, min(BLOCK, len(text)) - 64 * len(words))
                    if len(found[lang]) > HELD or long > 64 << 20:
                        yield from rows()
                        long = 0
            if sum(map(len, found.values())) > HELD:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(sliced(count, size=TEXT), "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _named(stash: Stash, rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows with ids from 1 on without gaps, and how many they are."""
    kept = stash(rows.withColumn("at", F.monotonically_increasing_id()))
    sizes = {r["p"]: r["n"] for r in kept.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return kept.select(F.lit(0).cast("long").alias("id"), *rows.columns), 0
    # A number for each task of a shuffle: what stands in the tasks before it.
    before = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes) + 1)])]).tolist()
    base = F.element_at(F.lit(before[:-1]), F.shiftright("at", 33).cast("int") + 1)
    return kept.select((base + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("long").alias("id"), *rows.columns), before[-1]


def _paired(at: np.ndarray) -> np.ndarray:
    """Whether the next entry is at the next position."""
    out = np.zeros(len(at), bool)
    out[:-1] = at[1:] == at[:-1] + 1
    return out


def _packed(seg: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Segments of (positions, ids), without entries that have no neighbour."""
    kept = []
    for s, (at, ids) in zip(seg, parts):
        near = _paired(at)
        near[1:] |= near[:-1].copy()
        if near.any():
            kept.append((s, at[near].astype(np.int32).tobytes(), ids[near].astype(np.int64).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["seg", "at", "id"])


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment (by place in the batch), position and id of all entries."""
    at = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    ids = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at).astype(np.int64), np.concatenate(ids)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, position and both ids where two neighbours have one."""
    seg, at, ids = _joined(batch)
    j = np.flatnonzero(_paired(at + seg * (4 * SEGMENT)))
    return seg[j], at[j], ids[j], ids[np.minimum(j + 1, max(0, len(ids) - 1))]


def pair_counts(sequences: DataFrame) -> DataFrame:
    """Rows (left, right, f): how many positions have these two names beside each other."""

    def summed(left, right, n):
        """Each pair once."""
        if len(left) and max(left.max(), right.max()) < 1 << 31:
            key, where = np.unique(left << 32 | right, return_inverse=True)
            return key >> 32, key & 0xFFFFFFFF, np.bincount(where, n, len(key)).astype(np.int64)
        (a, i), (b, j) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
        key, where = np.unique(i * max(1, len(b)) + j, return_inverse=True)
        return a[key // max(1, len(b))], b[key % max(1, len(b))], np.bincount(where, n, len(key)).astype(np.int64)

    def count(batches):
        held, size = [], 0
        for b in batches:
            _, at, left, right = _pairs(b)
            own = at < SEGMENT
            if own.any():
                held.append(summed(left[own], right[own], np.ones(own.sum())))
                size += len(held[-1][0])
            if size > 4 * HELD:
                held = [summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > 2 * HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["left", "right", "f"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*map(np.concatenate, zip(*held)))], names=["left", "right", "f"])

    return sequences.mapInArrow(sliced(count, size=TEXT), "left bigint, right bigint, f bigint").groupBy("left", "right").agg(F.sum("f").alias("f"))


def _gathered(rows: DataFrame) -> DataFrame:
    """Segments from their rows (seg, at, id), of which a segment has at most its positions."""

    def pack(batches):
        for b in batches:
            own, many = b.column(1).flatten(), b.column(1).value_lengths().to_numpy()
            at, ids = own.field("at").to_numpy(), own.field("id").to_numpy()
            order = np.lexsort((at, np.repeat(np.arange(len(many)), many)))
            ends = np.concatenate([[0], np.cumsum(many)])
            yield _packed(b.column(0).to_pylist(), [(at[order[x:y]], ids[order[x:y]]) for x, y in zip(ends, ends[1:])])

    return rows.groupBy("seg").agg(F.collect_list(F.struct("at", "id")).alias("places")).mapInArrow(sliced(pack), _SEQUENCE)


def word_sequences(docs: DataFrame, names: DataFrame, small: bool, reach: int) -> DataFrame:
    """Segments of the texts with the ids of frequent words; texts of a batch share segments, a break apart."""
    if small:
        table: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in names.select("id", "lang", "phrase").toArrow().to_pylist():
            table[r["lang"]][r["phrase"].encode("utf-8", "surrogatepass")] = r["id"]
        known = docs.sparkSession.sparkContext.broadcast(dict(table))

        def name(batches):
            seg = TaskContext.get().partitionId() << 33
            for b in batches:
                flat = []
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = known.value.get(lang, {})
                    for words in _tokens(text):
                        flat.append(np.array([ids.get(w, 0) for w in words], np.int64))
                    flat.append(np.zeros(1, np.int64))
                ids = np.concatenate(flat or [np.zeros(0, np.int64)])
                cuts = range(0, len(ids), SEGMENT)
                parts = [(np.flatnonzero(x), x[x > 0]) for x in (ids[a : a + SEGMENT + reach] for a in cuts)]
                yield _packed(list(range(seg, seg + len(parts))), parts)
                seg += len(parts)

        return docs.mapInArrow(sliced(name, size=TEXT), _SEQUENCE)

    def places(batches):
        seg = TaskContext.get().partitionId() << 33
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                place = 0
                for words in _tokens(text):
                    rows = [(seg + p // SEGMENT, p % SEGMENT, w) for p, w in enumerate(words, place) if w != b"."]
                    # What a phrase of the segment before may go on with stands there too.
                    rows += [(s - 1, at + SEGMENT, w) for s, at, w in rows if at < reach and s > seg]
                    place += len(words)
                    where, at, word = zip(*rows) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(at, pa.int32()), pa.array([lang] * len(rows), pa.string()), pa.array([w.decode("utf-8", "surrogatepass") for w in word], pa.string())], names=["seg", "at", "lang", "phrase"])
                seg += place // SEGMENT + 1

    words = docs.mapInArrow(sliced(places, size=TEXT), "seg bigint, at int, lang string, phrase string")
    return _gathered(words.join(names.select("id", "lang", "phrase"), ["lang", "phrase"]).select("seg", "at", "id"))


def pair_sequences(sequences: DataFrame, names: DataFrame, small: bool) -> DataFrame:
    """Segments of which each position has the name of the pair that begins there."""
    if small:
        table = names.select("left", "right", "id").toArrow()
        left, right, ids = (table.column(c).to_numpy() for c in ("left", "right", "id"))
        (lefts, i), (rights, j) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
        key = i * max(1, len(rights)) + j
        order = np.argsort(key)
        known = sequences.sparkSession.sparkContext.broadcast((lefts, rights, key[order], ids[order]))

        def name(batches):
            lefts, rights, keys, ids = known.value
            for b in batches:
                seg, at, left, right = _pairs(b)
                i, j = (np.minimum(np.searchsorted(t, x), len(t) - 1) for t, x in ((lefts, left), (rights, right)))
                key = i * len(rights) + j
                where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = (lefts[i] == left) & (rights[j] == right) & (keys[where] == key)
                seg, at, found = seg[ok], at[ok], ids[where[ok]]
                ends = np.searchsorted(seg, np.arange(b.num_rows + 1))
                yield _packed(b.column(0).to_pylist(), [(at[x:y], found[x:y]) for x, y in zip(ends, ends[1:])])

        return sequences.mapInArrow(sliced(name, size=TEXT), _SEQUENCE)

    def places(batches):
        for b in batches:
            seg, at, left, right = _pairs(b)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(seg)), pa.array(at.astype(np.int32)), pa.array(left), pa.array(right)], names=["seg", "at", "left", "right"])

    pairs = sequences.mapInArrow(sliced(places, size=TEXT), "seg bigint, at int, left bigint, right bigint")
    return _gathered(pairs.join(names.select("left", "right", "id"), ["left", "right"]).select("seg", "at", "id"))


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 5, min_count: int = 100, scale: int = 1000, share: int = 100, top: int = 2000, broadcast_names: int = BROADCAST) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to ``max_words`` words that stand at least ``min_count`` times (a) within a piece of text, of n words in all.
    score is floor(``scale`` * a * n / (l * r)) for the cut into two parts, standing l and r times, where it is lowest.
    A phrase goes if one that holds it stands at least ``share`` hundredths as often.
    """
    stash = Stash(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = stash(word_counts(src).where((F.col("f") >= min_count) | F.col("word").isNull()))
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    words = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    names, n = _named(stash, words)
    size = names.agg(F.sum(F.length("phrase"))).head()[0] or 0
    levels = []
    for k in range(2, max_words + 1):
        if not n:
            break
        small = n <= broadcast_names and (k > 2 or size <= 64 * broadcast_names)
        sequences = stash(word_sequences(src, names, small, max_words - 1) if k == 2 else pair_sequences(sequences, names, small), group_bytes=GROUP)
        left = names.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begun"), "heads")
        right = names.select(F.col("id").alias("right"), "last", "tails")
        found = pair_counts(sequences).where(F.col("f") >= min_count).join(left, "left").join(right, "right")
        own = F.array("f")
        names, n = _named(stash, found.select("left", "right", "lang", F.concat_ws(" ", "begun", "last").alias("phrase"), "last", "f", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails")))
        levels.append(names)
    kept = None
    for k, level in enumerate(levels, 2):
        if k - 1 < len(levels):
            longer = levels[k - 1]
            above = longer.select(F.col("left").alias("id"), "f").unionAll(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("above"))
            level = level.join(above, "id", "left").where(F.coalesce(100 * F.col("above") < share * F.col("f"), F.lit(True)))
        some = level.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails")
        kept = some if kept is None else kept.unionByName(some)
    if kept is None:
        kept = words.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails").limit(0)
    # A score is at most scale * n, so its quotient is a long; the products are not.
    whole = "decimal(38,0)"
    cuts = F.transform(
        F.sequence(F.lit(1), F.size("heads") - 1),
        lambda j: F.struct(F.element_at("heads", j).alias("l"), F.element_at("tails", F.size("tails") - j).alias("r"), j.alias("cut")),
    )
    high, low = F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"), lambda c: (c["l"].cast("decimal(19,0)") * c["r"].cast("decimal(19,0)")).cast(whole)
    scored = kept.join(totals, "lang").withColumn("high", (high.cast(whole) * F.lit(scale)).cast(whole))
    quotient = F.transform(cuts, lambda c: F.struct(F.call_function("div", F.col("high"), low(c)).alias("score"), c["cut"].alias("cut"), c["l"].alias("l"), c["r"].alias("r")))
    best = scored.withColumn("best", F.array_min(quotient)).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase")))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
