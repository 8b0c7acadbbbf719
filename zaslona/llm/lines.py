"""Line dedup by a log-template tree.

A line descends by its token count, then by its leading tokens, to a leaf; tokens that hold a digit are variable from
the start, unless most of a line's are: a row of numbers says nothing but its numbers and is compared as it stands. Below the leaf the remaining tokens are four fields of equal width. A template is a leaf with all fields
fixed, or with one of them generalised to a wildcard; so two lines share a template exactly if they have the same
length and leading tokens and differ within one quarter of the rest. A template that documents share is recurring:
its lines stay in the document with the smallest id and are dropped from all others.

The tree is flat: every line emits the keys of its five templates, which are pre-aggregated to smallest and largest
document id before the shuffle. No lines are compared in pairs and no leaf gathers anywhere.

Lines of fewer than ``GENERAL_FROM`` tokens have the ungeneralised template only, as a field of them would be no more
than a word and what differs is as a rule what they say.

Defined results: a null text stays null with no lines; lines of fewer than ``min_tokens`` tokens have no template;
rows with a null id lose no lines; rows with one id and one text lose the same lines; documents are never dropped, a
text may become empty; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, sliced

_DIGIT = re.compile(r"[0-9]")
#: Lines from this many tokens on have generalised templates; the fields of shorter ones would be no wider than a word.
GENERAL_FROM = 8


def templates(line: str, depth: int = 2, min_tokens: int = 3) -> list[int]:
    """Keys of a line's templates, signed 64-bit; the first is the ungeneralised one."""
    tokens = line.split()
    n = len(tokens)
    if n < min_tokens:
        return []
    if _DIGIT.search(line):
        masked = ["<*>" if _DIGIT.search(t) else t for t in tokens]
        if masked.count("<*>") * 2 > n:  # a row of numbers: one template, the line itself
            key = xxhash.xxh64_intdigest("\x1e".join(tokens).encode("utf-8", "surrogatepass"))
            return [key - (1 << 64) if key >> 63 else key]
        tokens = masked
    leaf, rest = f"{n}\x1f{' '.join(tokens[:depth])}\x1f", tokens[depth:]
    names = [leaf + " ".join(rest)]
    if n >= GENERAL_FROM:
        m = len(rest)
        for s in range(4):
            names.append(f"{leaf}{s}\x1f{' '.join(rest[: m * s // 4])}\x1f{' '.join(rest[m * (s + 1) // 4 :])}")
    keys = (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names)
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _parse(depth: int, min_tokens: int):
    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            row, line_no, key = [], [], []
            for r, text in enumerate(texts.to_pylist()):
                for i, line in enumerate(text.split("\n") if text else ()):
                    if found := templates(line, depth, min_tokens):
                        key += found
                        row += [r] * len(found)
                        line_no += [i] * len(found)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), hashes.take(take), pa.array(line_no, pa.int32()), pa.array(np.array(key, np.int64))], names=["id", "text_hash", "line_no", "key"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 2, min_tokens: int = 3) -> DataFrame:
    """The documents with recurring lines dropped, and n_lines and n_dropped (long)."""
    spark = docs.sparkSession
    stash = Stash(spark)
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    parsed = stash(src.where("text is not null and id is not null").mapInArrow(sliced(_parse(depth, min_tokens)), "id long, text_hash long, line_no int, key long"))
    recurring = parsed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    # The result needs only which lines go; the keys of all lines leave the disk.
    dropped = stash(parsed.join(recurring, "key").where("id > low").groupBy("id", "text_hash").agg(F.collect_set("line_no").alias("__gone")))
    stash.drop(parsed)
    stash.free()

    @F.pandas_udf("string")
    def without(texts, gone):
        import pandas as pd

        def one(text, lines):
            if text is None:
                return None
            away = set(lines)
            return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in away])

        return pd.Series([one(t, g) for t, g in zip(texts, gone)], dtype=object)

    hit = dropped.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone")
    both = docs.join(hit, (F.col(id_col).cast("long") == F.col("__id")) & (text_hash == F.col("__hash")), "left")
    n_gone = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    # Only texts that lose a line travel to Python.
    shorter = without(F.when(F.col("__gone").isNotNull(), F.col(text_col)), F.col("__gone"))
    kept = both.select(*[F.col(c) for c in docs.columns], n_lines.cast("long").alias("__n_lines"), n_gone.cast("long").alias("__n_gone"), shorter.alias("__short"), F.col("__gone").isNotNull().alias("__hit"))
    text = F.when(F.col("__hit"), F.col("__short")).otherwise(F.col(text_col)).alias(text_col)
    out = [text if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return kept.select(*out, F.col("__n_lines").alias("n_lines"), F.col("__n_gone").alias("n_dropped"))
