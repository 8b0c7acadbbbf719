"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows (13 consecutive words; all words of a shorter item) must occur whole. Exact containment makes the
necessary prefix of a window a single token: its rarest word, by how many times documents hold it. Document words
join on these prefix tokens; the token's offset fixes the one place where the window could start (positional bound)
and the window must fit into the document (length bound); the words there are then compared.

Windows are broadcast while they measure under ``broadcast_bytes``; beyond that document words are shuffled with the
words around them.

Defined results: null or wordless texts have no words and are never hit; repeated rows each get a row; rows are told
apart by id and text; null ids are allowed; items with a null id mark words but are not counted in n_items.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash

#: Between words of a text whose A-Z are still in upper case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A text's words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def windows(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (item_id, win, len): win an array of folded words."""
    w = items.select(F.col(item_col).alias("item_id"), words(folded(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    at = w.select("item_id", "w", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return at.select("item_id", F.slice("w", F.col("i"), F.col("len")).alias("win"), "len").distinct()


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, items (sorted array of strings), copies (how many rows it stands for)."""
    stash = Stash(docs.sparkSession)
    wins = stash(windows(items, item_col, item_text_col, size))
    bytes_ = wins.agg(F.sum(F.length(F.array_join("win", " ")) + 64)).head()[0] or 0
    small = bytes_ <= broadcast_bytes
    hinted = F.broadcast if small else (lambda df: df.hint("merge"))

    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words(F.col(text_col)).alias("w"))
    # Prefix tokens: the key folds more than A-Z does, so it only ever admits more candidates.
    vocabulary = wins.select(F.explode("win").alias("x")).select(F.lower("x").alias("key")).distinct()
    seen = src.select(F.explode("w").alias("x")).select(F.lower("x").alias("key")).join(hinted(vocabulary), "key", "left_semi")
    counts = seen.groupBy("key").agg(F.count("*").alias("df"))
    tokens = wins.withColumn("wid", F.xxhash64("item_id", "win")).select("item_id", "win", "len", "wid", F.posexplode("win").alias("off", "x")).withColumn("key", F.lower("x"))
    rated = tokens.join(hinted(counts) if small else counts, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = rated.groupBy("item_id", "win", "len").agg(F.min(F.struct("df", "key", "off")).alias("b"))
    # A window with a word that no document holds cannot occur.
    prefix = stash(best.where("b.df > 0").select(F.col("b.key").alias("key"), F.col("b.off").alias("off"), "item_id", "len", F.array_join("win", " ").alias("win_text")))

    # Element 0 stands for the document itself, so that one pass also yields the documents without a hit.
    n_words = F.size("w").alias("n_words")
    if small:
        at = src.select("doc_id", "text_hash", n_words, "w", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("w"))).alias("p", "x"))
        found = at.withColumn("key", F.lower("x")).join(F.broadcast(prefix), "key", "left").where("p = 0 or key is not null and win_text is not null")
        start = F.col("p") - 1 - F.col("off")
        there = F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col("len"), F.lit(0))), " ")
    else:
        at = src.select("doc_id", "text_hash", n_words, "w", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("w"))).alias("p", "x"))
        near = at.select("doc_id", "text_hash", "n_words", "p", F.lower("x").alias("key"), F.slice("w", F.greatest(F.col("p") - size + 1, F.lit(1)), 2 * size).alias("near"))
        found = near.join(prefix.hint("merge"), "key", "left").where("p = 0 or win_text is not null")
        start = F.col("p") - 1 - F.col("off")
        base = F.greatest(F.col("p") - size, F.lit(0))
        there = F.array_join(F.slice("near", F.greatest(start - base, F.lit(0)) + 1, F.greatest(F.col("len"), F.lit(0))), " ")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    ok = F.when(F.col("p") > 0, fits & (folded(there) == F.col("win_text"))).otherwise(F.lit(True))
    found = found.where(ok).select("doc_id", "text_hash", "n_words", (F.col("p") == 0).cast("int").alias("self"), F.when(F.col("p") > 0, F.struct(start.alias("s"), (start + F.col("len")).alias("e"))).alias("span"), F.when(F.col("p") > 0, F.col("item_id")).cast("string").alias("item"))
    per = found.groupBy("doc_id", "text_hash", "n_words").agg(F.sum("self").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    # Spans in order of start: each adds what lies beyond the furthest end so far.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate("spans", zero, lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    return per.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), "items", "copies")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    per = hits(docs, items, **options)
    every = per.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return every.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
