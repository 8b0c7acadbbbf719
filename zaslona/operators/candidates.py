"""Spans that a language model proposes: checked against the text, then masked wherever they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import MASKS

# Bounds of candidates, and the masks whose parts are no candidates. These are 14 of the 24 masks on
# purpose: results must be the same as before, so a part of another mask (such as NR-KSEF) is a candidate like any word.
MOST, SHORTEST, LONGEST = 100, 2, 80
KNOWN_MASKS = ("[EMAIL]", "[NR-KONTA]", "[PESEL]", "[NIP]", "[REGON]", "[TELEFON]", "[NR-DOWODU]", "[NR-PASZPORTU]", "[KRS]", "[KOD-POCZTOWY]", "[MIEJSCOWOŚĆ]", "[DATA-URODZENIA]", "[ADRES]", "[IMIĘ I NAZWISKO]")


def accepted(text: Column, candidates: Column) -> Column:
    """Candidates of fitting length that stand in the text and are no part of a mask, each once, the first 100."""
    known = F.array(*[F.lit(m) for m in KNOWN_MASKS])
    fits = lambda c: (
        F.length(c).between(SHORTEST, LONGEST) & F.contains(text, c) & ~c.rlike(r"^\[[^\[\]]*\]\z") & ~F.exists(known, lambda m: F.contains(m, c))
    )
    return F.slice(F.array_distinct(F.filter(candidates, lambda c: F.coalesce(fits(c), F.lit(False)))), 1, MOST)


def mask_candidates(df: DataFrame, text_col: str = "text", candidates_col: str = "candidates", mask: str = MASKS["IMIE"]) -> DataFrame:
    """Rows with redacted and hits; redacted is null where nothing was replaced. Longer candidates go first."""
    text = F.col(text_col)
    longest = F.array_sort(accepted(text, F.col(candidates_col)), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    zero = F.struct(text.alias("t"), F.lit(0).alias("n"))

    def step(acc, c):
        gone = F.length(acc["t"]) - F.length(F.replace(acc["t"], c, F.lit("")))
        return F.struct(F.replace(acc["t"], c, F.lit(mask)).alias("t"), (acc["n"] + gone / F.length(c)).cast("int").alias("n"))

    done = df.withColumn("__r", F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), zero, step))
    return done.select(*df.columns, F.when(F.col("__r.n") > 0, F.col("__r.t")).alias("redacted"), F.col("__r.n").alias("hits"))
