"""Analytics over findings: everything after the one Python step is grouped and joined in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import LABELS, MASKS

# Groups of kinds that are switched together, and the categories in which masks are shown.
GROUPS = {
    "person": ("IMIE",),
    "contact": ("EMAIL", "TELEFON", "LOGIN"),
    "identity": ("PESEL", "NIP", "REGON", "DOWOD", "PASZPORT", "KRS", "PRAWO-JAZDY", "NR-REJESTRACYJNY", "VIN", "ZNAK-SPRAWY", "KSEF"),
    "finance": ("IBAN", "NR-KONTA", "KARTA"),
    "network": ("IP", "MAC", "TOKEN"),
    "place": ("ADRES", "KOD-POCZTOWY", "MIEJSCOWOSC", "DATA-UR"),
}


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """One row per document and kind: the columns kept, type, count."""
    return df.select(*keep, F.explode("found").alias("f")).select(*keep, "f.type", F.col("f.count").alias("count"))


def merged(*found: Column) -> Column:
    """Several findings as one: counts added by type, in the order of first mention."""
    every = F.concat(*found)
    kinds = F.array_distinct(F.transform(every, lambda f: f["type"]))
    total = lambda k: F.aggregate(F.filter(every, lambda f: f["type"] == k), F.lit(0), lambda a, f: a + f["count"])
    return F.transform(kinds, lambda k: F.struct(k.alias("type"), total(k).alias("count")))


def by_document(df: DataFrame, id_col: str) -> DataFrame:
    """One row for each id that has findings: the id, found, with those of all its rows added by type, in the order of the kinds."""
    order = F.create_map(*[x for i, kind in enumerate(LABELS) for x in (F.lit(kind), F.lit(i))])
    sums = exploded(df, id_col).groupBy(id_col, "type").agg(F.sum("count").cast("int").alias("count"))
    kinds = F.sort_array(F.collect_list(F.struct(order[F.col("type")].alias("at"), "type", "count")))
    return sums.groupBy(id_col).agg(F.transform(kinds, lambda k: F.struct(k["type"].alias("type"), k["count"].alias("count"))).alias("found"))


def by_type(df: DataFrame) -> DataFrame:
    return exploded(df).groupBy("type").agg(F.sum("count").cast("long").alias("total"), F.count("*").alias("docs"))


def rollup(df: DataFrame, key: str) -> DataFrame:
    """Totals by key and type, by key, and over all (nulls)."""
    return exploded(df, key).rollup(key, "type").agg(F.sum("count").cast("long").alias("total"))


def cube(df: DataFrame, key: str) -> DataFrame:
    return exploded(df, key).cube(key, "type").agg(F.sum("count").cast("long").alias("total"))


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n keys with most findings; ties by key."""
    return exploded(df, key).groupBy(key).agg(F.sum("count").cast("long").alias("total")).orderBy(F.desc("total"), key).limit(n)


def summary(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Occurrences, distinct names of what was found, documents with findings: rows, or distinct ids if ``id_col`` names them."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    row = F.col(id_col) if id_col else F.monotonically_increasing_id()
    e = df.select(row.alias("row"), "found").select("row", F.explode("found").alias("f"))
    return e.agg(F.coalesce(F.sum("f.count"), F.lit(0)).cast("long").alias("total"), F.countDistinct(names[F.col("f.type")]).alias("labels"), F.countDistinct("row").alias("docs"))


def mask_tokens(spark) -> DataFrame:
    """The dimension of masks: token, type, label, category."""
    group = {t: g for g, kinds in GROUPS.items() for t in kinds}
    return spark.createDataFrame([(m, t, LABELS[t], group[t]) for t, m in MASKS.items()], "token string, type string, label string, category string")


def types_of(groups: dict[str, bool]) -> list[str] | None:
    """Kinds of the groups switched on; None if all are."""
    return None if all(groups.get(g, True) for g in GROUPS) else [t for g, kinds in GROUPS.items() if groups.get(g, True) for t in kinds]
