"""Recall and precision of redaction over labelled cases, and the regression gate.

A case holds must_mask (what may not stay) and must_keep (what may not go). The precision is a stand-in: the share of
must_keep that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the gate asks for.
FULL_RECALL = ("basic", "inflected", "rare", "structural", "dictionary")
LEAST_PRECISION = 0.98


def evaluated(df: DataFrame, redacted: str = "redacted") -> DataFrame:
    """Cases with leaked (must_mask that stays) and eaten (must_keep that is gone)."""
    r = F.col(redacted)
    return df.withColumn("leaked", F.filter("must_mask", lambda s: F.contains(r, s))).withColumn("eaten", F.filter("must_keep", lambda s: ~F.contains(r, s)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for nothing."""
    return F.try_divide(a, b)


def f1(recall: Column, precision: Column) -> Column:
    return F.try_divide(2 * recall * precision, recall + precision)


def metrics(cases: DataFrame) -> DataFrame:
    """Per category and (category null) over all: sums, recall, precision, f1."""
    sums = cases.rollup("category").agg(
        F.sum(F.size("must_mask")).cast("long").alias("mask_total"),
        F.sum(F.size("must_mask") - F.size("leaked")).cast("long").alias("mask_hit"),
        F.sum(F.size("must_keep")).cast("long").alias("keep_total"),
        F.sum(F.size("must_keep") - F.size("eaten")).cast("long").alias("keep_hit"),
    )
    rates = sums.withColumn("recall", ratio(F.col("mask_hit"), F.col("mask_total"))).withColumn("precision", ratio(F.col("keep_hit"), F.col("keep_total")))
    return rates.withColumn("f1", f1(F.col("recall"), F.col("precision")))


def failures(cases: DataFrame) -> DataFrame:
    return cases.where((F.size("leaked") > 0) | (F.size("eaten") > 0))


def changed(core: DataFrame, layer: DataFrame, id_col: str = "id") -> DataFrame:
    """How many cases a further layer leaves otherwise than the core."""
    both = core.select(id_col, F.col("redacted").alias("a")).join(layer.select(id_col, F.col("redacted").alias("b")), id_col)
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def pivoted(rates: DataFrame, categories: list[str], value: str = "recall") -> DataFrame:
    """One column per category; by naming them no extra pass finds them."""
    return rates.where("category is not null").groupBy().pivot("category", categories).agg(F.first(value))


def category_order(cases: DataFrame, order_col: str) -> DataFrame:
    """Categories by their first case: category, place (from 1)."""
    first = cases.groupBy("category").agg(F.min(order_col).alias("first"))
    before = F.row_number().over(Window.orderBy("first"))  # as many rows as there are categories
    return first.select("category", before.alias("place"))


def gate_faults(rates: DataFrame) -> DataFrame:
    """What falls short of the gate, a row each (fault). The metric table has a row per category."""
    said = lambda what, value: F.format_string(f"{what} %.3f", value)
    over_all = F.col("category").isNull() & (F.col("precision") < LEAST_PRECISION)
    one = F.col("category").isin(*FULL_RECALL) & (F.col("recall") < 1)
    fault = F.when(over_all, said("precision", F.col("precision"))).when(one, F.concat(F.lit("recall of "), "category", F.format_string(" %.3f", F.col("recall"))))
    return rates.select(fault.alias("fault")).where("fault is not null")


def gate(rates: DataFrame) -> list[str]:
    """The same as a list; empty if all is well."""
    return sorted(r["fault"] for r in gate_faults(rates).collect())


def report(rates: DataFrame, order: list[str] | None = None) -> str:
    """The metric table as Markdown; categories in the given order (as first seen), else by name."""
    place = {c: i for i, c in enumerate(order or ())}
    shown = lambda x: "–" if x is None else f"{100 * x:.1f} %"
    rows = sorted(rates.collect(), key=lambda r: (r["category"] is None, place.get(r["category"], len(place)), r["category"] or ""))
    return "\n".join(["| category | recall | precision | F1 |", "|---|---|---|---|", *(f"| {r['category'] or 'all'} | {shown(r['recall'])} | {shown(r['precision'])} | {shown(r['f1'])} |" for r in rows)])
