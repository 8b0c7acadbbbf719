"""Redaction in layers: the rules, then a token classifier's service, then a language model's spans.

Each further layer sees only what the one before left, and may be lost: its failure leaves the text as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.remote import llm_layer, ner_layer, post
from .candidates import mask_candidates
from .findings import merged
from .redact import redact
from .rules import MASKS


def _persons(n):
    """n persons as findings."""
    return F.when(n > 0, F.array(F.struct(F.lit("IMIE").alias("type"), n.cast("int").alias("count")))).otherwise(F.array().cast("array<struct<type:string,count:int>>"))


def _masks(text):
    mask = MASKS["IMIE"]
    return (F.length(text) - F.length(F.replace(text, F.lit(mask), F.lit("")))) / len(mask)


def redact_layers(df: DataFrame, text_col: str = "text", ner_url: str | None = None, ask: Callable[[str], list] | None = None, send: Callable = post, course: dict | None = None, **options) -> DataFrame:
    """The rows with redacted and found after all layers that are given. ``course`` says how services are asked (``remote.Course``)."""
    out = redact(df, text_col, **options)
    if ner_url:
        out = ner_layer(out, ner_url, send=send, **(course or {})).withColumn("__t", F.coalesce("ner", "redacted"))
        more = F.greatest(_masks(F.col("__t")) - _masks(F.col("redacted")), F.lit(0))
        out = out.withColumn("found", merged(F.col("found"), _persons(more))).withColumn("redacted", F.col("__t")).drop("__t", "ner", "ner_note", "ner_tries")
    if ask:
        kept = [c for c in out.columns if c != "redacted"]
        out = mask_candidates(llm_layer(out, ask, **(course or {})).withColumnRenamed("redacted", "__t"), "__t")
        out = out.withColumn("found", merged(F.col("found"), _persons(F.col("hits")))).select(*kept, F.coalesce("redacted", "__t").alias("redacted"))
    return out
