"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents;
the last adds its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zaslona.llm import decontaminate, lines, pieces, quality, simhash
from zaslona.llm.common import Stash, components, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is kept from this quality score on.
KEEP_FROM = 0.3
#: Words in the shingles of near duplicates.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = quality.with_score(docs, table(spark, sf_dir, "labels"), columns=COLUMNS)
    return scored.where(F.col("score") >= KEEP_FROM).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template a document of smaller id has; n_chars follows the text."""
    out = lines.dedup(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by SimHash and by similarity, the document with the smallest id; of rows that repeat it, one.

    Rows without an id go if a document with an id has their like, and stay otherwise.
    """
    stash = Stash(spark)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(text_hash.alias("u"), "text")
    # Fingerprints by their balls, as in op3. What they miss at their radius is linked by similarity itself; a group is a chain of either.
    near = stash(simhash.groups(texts, id_col="u", shingle=SHINGLE).select("u", F.col("component_id").alias("v")).where("u <> v").distinct())
    stash.free()
    like = simhash.similar(texts, id_col="u", shingle=SHINGLE).select("u", F.col("component_id").alias("v")).where("u <> v").distinct()
    roots = components(near.unionAll(like), stash).select(F.col("u").alias("text_hash"), "root")
    found = docs.select("doc_id", text_hash.alias("text_hash")).join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    found = found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    gone = found.where("component_id is not null and not doc_id <=> component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    kept = docs.select(*COLUMNS, text_hash.alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    return kept.join(gone, same, "left_anti").dropDuplicates(["doc_id", "text_hash"]).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    marks = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    bad = marks.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("bad_hash"))
    return docs.join(bad, same, "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces."""
    out = pieces.with_ids(docs.select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", keep_first_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: SQL cannot express these stages. Tests hold line dedup, near duplicates (by exact similarity), decontamination and
#: pieces (by the library) against brute force, and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and read again."""
    stash, docs = Stash(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
