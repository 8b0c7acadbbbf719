"""Redaction of a text column.

One Arrow-batched function runs the whole fold for a row; the plan has a single Python step whatever kinds are asked
for. Kinds whose rule is one plain pattern also have an expression form (``native``) that stays in the JVM and is
gated by a cheap test, for when only they are wanted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.lexicon import DEFAULT, Lexicon
from . import rules as R
from .fold import _names, masked_places, redact_text

FINDING = T.StructType([T.StructField("type", T.StringType(), False), T.StructField("count", T.IntegerType(), False)])
RESULT = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("found", T.ArrayType(FINDING, False))])


def redaction(types: Iterable[str] | None = None, masks: Mapping[str, str] | None = None, pseudonyms: bool = False, lexicon: Lexicon = DEFAULT, guarded: bool = True):
    """A column function: text to struct<redacted, found>. Null and empty texts give '' and no findings.

    ``guarded`` false is for texts in other languages, where words that end in ust or read ver refer to nothing.
    """
    kinds = None if types is None else tuple(types)
    given = dict(masks or {})
    if unknown := set(kinds or ()) - set(R.MASKS):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        # A text that stands in a batch again is not folded again: its result depends on nothing else. Nor is one folded
        # further than to where another of the batch has become the same.
        # Names are looked up once: each task has a lexicon of its own, which is compared list by list with a known one.
        onward, names = {}, _names(lexicon)
        known, lists = {}, {}  # texts of the same counts share one list
        for t in dict.fromkeys(texts):
            text, counts = redact_text(t, kinds, given, pseudonyms, names, guarded, onward)
            if (key := tuple(counts)) not in lists:
                lists[key] = [{"type": k, "count": n} for k, n in counts]
            known[t] = text, lists[key]
        return pd.DataFrame({"redacted": [known[t][0] for t in texts], "found": [known[t][1] for t in texts]})

    return run


#: Kinds of one plain pattern, and what a text holds in which they can also stand otherwise: a link or a field.
_PLAIN, _OTHERWISE = ("EMAIL",), r"""https?://|www\.|</|"\s*:\s*\""""


def redact(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows with columns redacted and found. Where only plain kinds are asked for, most texts stay in the JVM."""
    kinds = options.get("types")
    if kinds is not None and list(kinds) and set(kinds) <= set(_PLAIN):
        text, mask = F.coalesce(F.col(text_col), F.lit("")), {**R.MASKS, **(options.get("masks") or {})}["EMAIL"]
        odd = F.contains(text, F.lit("@")) | F.contains(text, F.lit("%40")) | F.contains(text, F.lit("(at)"))
        odd = odd & text.rlike(_OTHERWISE)
        # Two scans, of which the second has few rows, cost less than a Python step that all rows pass by.
        kept = [c for c in df.columns if c not in ("redacted", "found")]
        plain, n = native(text, "EMAIL", mask)
        found = F.when(n > 0, F.array(F.struct(F.lit("EMAIL").alias("type"), n.cast("int").alias("count")))).otherwise(F.array().cast(RESULT["found"].dataType))
        most = df.where(~odd).select(*kept, plain.alias("redacted"), found.alias("found"))
        rest = df.where(odd).withColumn("__r", redaction(**options)(text)).select(*kept, "__r.redacted", "__r.found")
        return most.unionByName(rest)
    return df.withColumn("__r", redaction(**options)(F.col(text_col))).select(*[c for c in df.columns if c not in ("redacted", "found")], "__r.redacted", "__r.found")


def has_pii(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows whose text holds personal data."""
    return redact(df, text_col, **options).where(F.size("found") > 0).select(*df.columns)


def labels_of(found: Column) -> Column:
    """What was found, named for people, each name once, in order."""
    names = F.create_map(*[F.lit(x) for pair in R.LABELS.items() for x in pair])
    return F.array_distinct(F.transform(found, lambda f: names[f["type"]]))


# Expression forms. Java's \d and \w are ASCII as well; (?U) is not set.

_NATIVE = {
    "EMAIL": (R.EMAIL, "@"),
    "TOKEN": (f"{R.JWT}|{R.KEYS}", "_"),
    "MAC": (r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", None),
}


def native(text: Column, kind: str, mask: str | None = None) -> tuple[Column, Column]:
    """Redacted text and count by one pattern. Texts without the sign that every match holds are not searched."""
    pattern, sign = _NATIVE[kind]
    gate = F.contains(text, F.lit(sign)) if sign and kind == "EMAIL" else F.lit(True)
    out = F.when(gate, F.regexp_replace(text, pattern, (mask or R.MASKS[kind]).replace("\\", "\\\\").replace("$", "\\$"))).otherwise(text)
    return out, F.when(gate, F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0))


# Patterns as they stand in the text, for counting alone. An address is tried where a run of its signs begins or the last
# one ended, so that a long run without an address is passed once; both give the matches of the plain patterns.
_LOCAL, _OCTET = R.EMAIL[: R.EMAIL.index("]") + 1], "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_COUNTED = {
    "EMAIL": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++" + R.EMAIL[len(_LOCAL) + 1 :], "@"),
    "IP": (rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9.])", "."),
}


def counted(df: DataFrame, kinds: Iterable[str], text_col: str = "text") -> DataFrame:
    """The rows with a column found: how often each kind's plain pattern stands in it, without Python.

    Unlike in ``redact``, no kind takes away from another one's places, and links and fields are text like any other:
    an IP number in a link or before an @ counts, an address with %40 and IPv6 do not.
    """
    text = F.col(text_col)
    each = []
    for kind in kinds:
        pattern, sign = _COUNTED[kind]
        n = F.when(F.contains(text, F.lit(sign)), F.regexp_count(text, F.lit(pattern))).otherwise(F.lit(0)).cast("int")
        each.append(F.struct(F.lit(kind).alias("type"), n.alias("count")))
    found = F.filter(F.array(*each), lambda f: f["count"] > 0)
    return df.select(*[c for c in df.columns if c != "found"], found.alias("found"))


PLACE = T.StructType([T.StructField("mask", T.StringType()), T.StructField("original", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def places(types: Iterable[str] | None = None, masks: Mapping[str, str] | None = None, pseudonyms: bool = False, lexicon: Lexicon = DEFAULT):
    """A column function: text to array<struct<mask, original, start, end>>, as the rules' edits have it."""
    kinds = None if types is None else tuple(types)
    given = dict(masks or {})
    if unknown := set(kinds or ()) - set(R.MASKS):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")

    @F.pandas_udf(T.ArrayType(PLACE))
    def run(texts: pd.Series) -> pd.Series:
        names = _names(lexicon)
        return pd.Series([[dict(zip(PLACE.names, p)) for p in masked_places(t, kinds, given, pseudonyms, names)] for t in texts], dtype=object)

    return run


def spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per masked place: the id, ord, mask, original, start and end (code points of the text)."""
    found = df.select(id_col, F.posexplode(places(**options)(F.col(text_col))).alias("ord", "p"))
    return found.select(id_col, "ord", "p.mask", "p.original", "p.start", "p.end")


class PiiSpans:
    """The table function pii_spans(text, types, pseudonyms): rows (ord, mask, start, end, original), as ``spans`` gives them.

    types is a constant, kinds apart by commas (null for all); pseudonyms a constant truth value. Null and empty texts
    give no rows.
    """

    def __init__(self, asked: Asked):
        self.asked = asked

    @staticmethod
    def analyze(text: AnalyzeArgument, types: AnalyzeArgument | None = None, pseudonyms: AnalyzeArgument | None = None) -> Asked:
        if not isinstance(text.dataType, T.StringType):
            raise ValueError("pii_spans: the text must be a string")
        for name, given in (("types", types), ("pseudonyms", pseudonyms)):
            if given is not None and not given.isConstantExpression:
                raise ValueError(f"pii_spans: {name} must be a constant")
        kinds = None if types is None or types.value is None else tuple(k.strip() for k in types.value.split(",") if k.strip())
        if unknown := set(kinds or ()) - set(R.MASKS):
            raise ValueError(f"pii_spans: unknown kinds: {sorted(unknown)}")
        fields = [T.StructField("ord", T.IntegerType()), *(PLACE[c] for c in ("mask", "start", "end", "original"))]
        return Asked(T.StructType(fields), kinds=kinds, pseudonyms=bool(pseudonyms and pseudonyms.value))

    def eval(self, text, types=None, pseudonyms=None):
        for i, (mask, original, start, end) in enumerate(masked_places(text, self.asked.kinds, None, self.asked.pseudonyms)):
            yield i, mask, start, end, original


@dataclass
class Asked(AnalyzeResult):
    """What a call of pii_spans asks for, worked out once while the query is planned."""

    kinds: tuple[str, ...] | None = None
    pseudonyms: bool = False


def register(spark: SparkSession) -> None:
    """Makes pii_spans known to the session's SQL."""
    spark.udtf.register("pii_spans", F.udtf(PiiSpans, useArrow=True))
