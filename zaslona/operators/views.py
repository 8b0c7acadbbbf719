"""Views of redacted texts: what each mask replaced, marked masks, numbered lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import rx
from .rules import MASKS, escaped

TOKEN = r"\[(?:" + "|".join(sorted({m[1:-1] for m in MASKS.values()}, key=len, reverse=True)) + r"|OSOBA-[A-Z]+)\]"
#: Texts beyond this many characters are shown without marks.
MARK_LIMIT = 300_000


def located(original: str, redacted: str) -> list[tuple[str, str, int, int]]:
    """Each mask with what stood in its place, and where: mask, original, start, end.

    The text between two masks is looked up in order in the original, without regard to case and white space where it
    is not found as it stands; if it is not there at all, the masks around it share what lies between.
    """
    marks = list(rx(TOKEN).finditer(redacted))
    cuts = [0, *(x for m in marks for x in m.span()), len(redacted)]
    between = [redacted[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
    places, at = [], 0
    for i, piece in enumerate(between):
        place = _found(original, piece, at, i == 0, i == len(between) - 1)
        places.append(place)
        at = place[1] if place else at
    out = []
    for i, m in enumerate(marks):
        start = next((p[1] for p in reversed(places[: i + 1]) if p), 0)
        end = next((p[0] for p in places[i + 1 :] if p), len(original))
        out.append((m.group(), original[start:end], start, end))
    return out


def replaced(original: str, redacted: str) -> list[tuple[str, str]]:
    """Each mask with what stood in its place."""
    return [r[:2] for r in located(original, redacted)]


def _found(original: str, piece: str, at: int, first: bool, last: bool) -> tuple[int, int] | None:
    """Where a piece lies in the original from ``at`` on: at the very start or end for the first or last."""
    if first and original.startswith(piece):
        return 0, len(piece)
    if last and original.endswith(piece) and len(original) - len(piece) >= at:
        return len(original) - len(piece), len(original)
    if not piece.strip():
        return None
    if (where := original.find(piece, at)) >= 0:
        return where, where + len(piece)
    loose = rx(r"\s+".join(escaped(w) for w in piece.split()), True).search(original, at)
    return loose.span() if loose else None


def compare(df: DataFrame, id_col: str, original: str, redacted: str) -> DataFrame:
    """One row per mask: the id, ord, mask, original, start, end (places in the original)."""

    @F.pandas_udf("array<struct<mask string, original string, start int, end int>>")
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("mask", "original", "start", "end")
        return pd.Series([[dict(zip(names, r)) for r in located(x or "", y or "")] for x, y in zip(a, b)], dtype=object)

    found = df.select(id_col, F.posexplode(pairs(F.col(original), F.col(redacted))).alias("ord", "p"))
    return found.select(id_col, "ord", "p.mask", "p.original", "p.start", "p.end")


def masks_in(text: Column) -> Column:
    """The masks of a text in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def masks_put_in(df: DataFrame, original: str = "text", redacted: str = "redacted") -> DataFrame:
    """Rows (mask, total): how often each mask was put in; those that the original texts hold already are none."""
    counted = lambda text, n: F.transform(masks_in(F.coalesce(F.col(text), F.lit(""))), lambda m: F.struct(m.alias("mask"), F.lit(n).alias("n")))
    marks = df.select(F.explode(F.concat(counted(redacted, 1), counted(original, -1))).alias("m"))
    return marks.groupBy("m.mask").agg(F.sum("m.n").alias("total")).where("total > 0")


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def marked_html(text: Column) -> Column:
    """Escaped text with its masks in <mark>; very long texts without."""
    safe = escaped_html(text)
    return F.when(F.length(text) > MARK_LIMIT, safe).otherwise(F.regexp_replace(safe, f"({TOKEN})", "<mark>$1</mark>"))


def numbered_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: the id, line (from 1), value."""
    lines = df.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("i", "value"))
    return lines.select(id_col, (F.col("i") + 1).alias("line"), "value")


def measures(text: Column) -> tuple[Column, Column]:
    """Lines and characters of a text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"), n.alias("n_chars")
