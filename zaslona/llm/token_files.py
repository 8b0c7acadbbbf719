"""Token ids as ORC files in order of documents.

Documents are dealt out by ranges of ids, each task sorts its range and encodes it, and Spark's ORC writer stores a
row per document: its id, how many ids stand before it in its part, its number of ids, and the ids. ORC keeps integers
in run-length encoding, an index entry for every ``stride`` rows and, on the document id, a Bloom filter for each
entry. A small second table has a row per part with the number of ids before it. Readers therefore take stripes side by
side, and what asks for some documents or for a stretch of ids (``read``, ``stretch``) skips parts, stripes and index
entries that cannot hold them.

A text is encoded by the library in units: no piece of its pattern goes on from a visible character to white space, so
texts are cut there, and each process asks the library for a repeated unit once, for all new ones of a batch together.

Defined results: a null or empty text has the end id only; rows without an id come first; of rows with one id the
order is that of their texts' hashes; repeated rows each get a row; no documents give no rows. The end id is no id of
the vocabulary's special tokens unless the caller names one; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, sliced

#: Bytes of text that a part gets on average.
PART_BYTES = 64 << 20
#: Rows an index entry covers, and units whose ids a process remembers.
STRIDE, REMEMBERED = 1000, 1_200_000
#: Characters of a unit that is remembered, and of what the library is given at once.
LONGEST, AT_ONCE = 64, 1 << 18
_SCHEMA = "part int, doc_id bigint, before bigint, n_tokens bigint, ids array<int>"
_PARTS = "part int, n_docs bigint, n_tokens bigint, start bigint"


class Encoder:
    """The library's ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # A byte of text is one character of a token's name.
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        # Units with the white space before them, and what was known before the last clearing.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The library's encodings weigh many times their texts, so it gets a stretch of texts at once."""
        return [np.array(e.ids, "<u4") for a, b in _stretches(texts) for e in self.library.encode_batch_fast(texts[a:b], add_special_tokens=False)]

    def joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that begin with white space and end in a visible character, read as one text a stretch.

        Ids are dealt out by the bytes that their tokens stand for.
        """
        out = []
        for i, j in _stretches(texts):
            ids = self.whole(["".join(texts[i:j])])[0]
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, texts[i:j])), np.int64, j - i))
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _units(self, units: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of different units the ids, which may stand apart, and which end in a visible character."""
        ids = list(map(self.known.get, units))
        apart = np.ones(len(units), bool)
        ends = np.ones(len(units), bool)
        new = []
        for k in [k for k, x in enumerate(ids) if x is None]:
            unit = units[k]
            if not _apart(unit):
                apart[k], ends[k], ids[k] = False, unit != "" and _visible(unit[-1]), b""
            elif (known := self.older.get(unit)) is not None:
                ids[k] = self.known[unit] = known
            else:
                new.append(k)
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        for k, found in zip(new, self.joined([units[k] if units[k][0] == "\n" else " " + units[k] for k in new])):
            ids[k] = found
            if len(units[k]) <= LONGEST:
                self.known[units[k]] = found
        return ids, apart, ends

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has, with ``end_id`` after each."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = np.asarray(split.offsets).astype(np.int64)
        flat = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        which, units = np.asarray(flat.indices).astype(np.int64), flat.dictionary.to_pylist()
        ids, apart, ends = self._units(units)
        # A unit is read apart if it may and the character before it is visible; all others form stretches.
        ok = apart[which]
        ok[1:] &= ends[which[:-1]]
        ok[offsets[:-1][offsets[:-1] < len(ok)]] = False
        begins = ~ok
        begins[1:] &= ok[:-1] | np.isin(np.arange(1, len(ok)), offsets)
        starts = np.flatnonzero(begins)
        stops = np.append(ok, True)
        stops[offsets] = True
        marks = np.flatnonzero(stops)
        last = marks[np.searchsorted(marks, starts, side="right")]
        first = set(offsets[:-1].tolist())
        rest = []
        for i, j in zip(starts.tolist(), last.tolist()):
            row = [units[k] for k in which[i:j].tolist()]
            lead = "" if i in first or row[0][:1] == "\n" else " "
            rest.append(lead + "".join(u if k == 0 or u[:1] == "\n" else " " + u for k, u in enumerate(row)))
        # Every place takes an entry of a pool: its unit's, its stretch's at the first place of one, or the empty one.
        entries = [*ids, *(x.tobytes() for x in self.whole(rest)), b"", b"" if end_id is None else np.array([end_id], "<u4").tobytes()]
        which[~ok] = len(entries) - 2
        which[starts] = len(ids) + np.arange(len(starts))
        which = np.insert(which, offsets[1:], len(entries) - 1)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        pool, begin = np.frombuffer(b"".join(entries), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[which]
        to = np.cumsum(lengths)
        out = pool[np.repeat(begin[which] - to + lengths, lengths) + np.arange(to[-1] if len(to) else 0)]
        places = np.concatenate([[0], to])
        bounds = places[offsets + np.arange(len(offsets))]
        return out, np.diff(bounds)


def _stretches(texts: list[str]) -> list[tuple[int, int]]:
    """Places of texts in stretches of about ``AT_ONCE`` characters: each ends with the text that reaches it."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // AT_ONCE
    cuts = (np.flatnonzero(np.diff(ends)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(texts)])) if texts else []


_PRINTED = frozenset(map(chr, range(33, 127)))


def _visible(c: str) -> bool:
    return c in _PRINTED or c.isprintable() and not c.isspace()


def _apart(unit: str) -> bool:
    """Whether a unit's pieces are the same after any visible character: it begins (after a line end) and ends visibly."""
    first = unit[:1]
    if first == "\n":
        first = unit[1:2]
    return first != "" and _visible(first) and _visible(unit[-1])


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, part_bytes: int = PART_BYTES, stride: int = STRIDE, stripe_bytes: int = 64 << 20) -> None:
    """Writes the documents' ids, each followed by ``end_id``, to ``path``/ids, and the parts to ``path``/parts.

    ``tokenizer`` names a file of the tokenizers library, which every executor has. Parts follow each other in order
    of ids; an id with very many rows is split by its texts' hashes and by where its rows stand in the input.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("at")]
    keyed = src.withColumn("h", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, sizes = enc.encode(b.column(1), end_id)
            flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids.tobytes())])
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), b.column(0), pa.array(starts), pa.array(sizes), rows], names=["part", "doc_id", "before", "n_tokens", "ids"])

    out = dealt.mapInArrow(sliced(encode, rows=4096, size=4 << 20), _SCHEMA).write.option("compression", "zstd").option("orc.create.index", "true")
    out = out.option("orc.row.index.stride", str(stride)).option("orc.stripe.size", str(stripe_bytes)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out.orc(f"{path}/ids")
    sums = spark.read.schema(_SCHEMA).orc(f"{path}/ids").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).orderBy("part").collect()
    parts, start = [], 0
    for r in sums:  # one row a part, of some 64 MB of text
        parts.append((r["part"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    spark.createDataFrame(parts, _PARTS).coalesce(1).write.orc(f"{path}/parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, n_docs, n_tokens, start)."""
    return spark.read.schema(_PARTS).orc(f"{path}/parts")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids), of the named documents or of all. Spark prunes by row index and Bloom filter."""
    rows = spark.read.schema(_SCHEMA).orc(f"{path}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))
    starts = F.broadcast(parts(spark, path).select("part", F.col("start").alias("base")))
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def stretch(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows (doc_id, start, ids) with the ids at places ``first`` to ``last`` - 1 of all ids, as by documents cut to it.

    Parts outside of it are left out by their starts, rows of the others by the index on ``before``.
    """
    near = parts(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first)).orderBy("part").select("part", "start").collect()
    held = F.lit(False)
    if near:
        (a, at_a), (b, at_b) = near[0], near[-1]
        early = (F.col("part") == a) & (F.col("before") + F.col("n_tokens") <= first - at_a)
        held = F.col("part").between(a, b) & ~early & ~((F.col("part") == b) & (F.col("before") >= last - at_b))
    rows = spark.read.schema(_SCHEMA).orc(f"{path}/ids").where(held)
    starts = F.broadcast(parts(spark, path).select("part", F.col("start").alias("base")))
    at = rows.join(starts, "part").withColumn("start", F.col("base") + F.col("before")).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    keep = (F.least(F.lit(last), F.col("start") + F.col("n_tokens")) - F.col("start")).cast("int") - skip
    return at.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, keep).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """Rows of ``read`` as (doc_id, start, n_tokens, ids_crc32), the checksum of the ids as stored little-endian."""

    def crc(batches):
        for b in batches:
            ids = b.column(3)
            sums = [zlib.crc32(np.asarray(ids.values[i:j]).astype("<u4").tobytes()) for i, j in zip(ids.offsets[:-1].to_pylist(), ids.offsets[1:].to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(sliced(crc), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the ids to the shared folder, reads the files back and returns their checksums by document."""
    spark = docs.sparkSession
    path = Stash(spark).path()
    write(docs, path, tokenizer, **options)
    return checksums(read(spark, path))
