"""Labelled sentences by category, to measure what redaction finds and what it leaves alone.

Names, forms and sentences are drawn by the seeded generator, by the place of a row's key, from lists of their own, which
were not made from the lexicon: common names, their forms, and rare ones. A table of keys gives as many cases as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.redact import redact
from ..sources.synthetic import chosen, random_number

_MEN = "Adam Aleksander Andrzej Bogdan Czesław Damian Edward Eugeniusz Grzegorz Ireneusz Jacek Jerzy Kamil Leszek Łukasz Marcin Mieczysław Norbert Przemysław Ryszard Sebastian Tadeusz Wacław Zbigniew Zenon".split()
_WOMEN = "Agnieszka Aneta Bożena Czesława Danuta Edyta Ewelina Grażyna Halina Iwona Jadwiga Karolina Lucyna Marzena Monika Olga Renata Sylwia Urszula Wiesława".split()
_FAMILIES = """Nowak Wójcik Kamiński Lewandowski Zieliński Szymański Woźniak Dąbrowski Kozłowski Mazurkiewicz Kwiatkowski
Krawczyk Kaczmarek Piotrowski Grabowski Pawłowski Michalski Nowicki Adamczyk Zawadzki Jabłoński Majewski Stępień Malinowski
Jaworski Pawlak Witkowski Walczak Rutkowski Michalak Szewczyk Ostrowski Tomaszewski Pietrzak Marciniak Wróblewski Zalewski
Jakubowski Sadowski Duda Bąk Włodarczyk Borkowski Chmielewski Sokołowski Szczepański Sawicki Kucharski Lis Maciejewski
Kubiak Kalinowski Wysocki Mazur Kołodziej Czerwiński Cieślak Głowacki Urbański Sikorski Krajewski Laskowski Ziółkowski""".split()
_RARE = "Bakuła Gzowski Pyrzanowski Tchórzewski Brzęczyszczykiewicz Rzepnikowski Kociubiński Wasiluk Szafraniec Dziekoński Przewłocki Iłłakowicz".split()
_WORDS = ["umowę zawarto w maju", "wniosek rozpoznano na posiedzeniu", "Sąd Rejonowy w Gdańsku oddalił wniosek", "kwota 1250,50 zł za 12 sztuk", "Rzecznik Praw Obywatelskich zabrał głos", "wersja 2.10.4 programu działa", "art. 15 ust. 2 pkt 3 ustawy", "Urząd Skarbowy wydał decyzję", "dostawa do 14 dni roboczych", "Ministerstwo Finansów ogłosiło zmiany"]


def _genitive(family: str) -> str:
    if family.endswith("ski") or family.endswith("cki") or family.endswith("dzki"):
        return family + "ego"
    if family.endswith("a"):
        return family[:-1] + ("i" if family[-2] in "kg" else "y")
    if family.endswith("ień"):
        return family[:-3] + "nia"
    if family.endswith("ek"):
        return family[:-2] + "ka"
    return family + ("ia" if family.endswith(("dziej",)) else "a")


def _of(name: str) -> str:
    return name[:-2] + "ka" if name.endswith("ek") else name + "a" if not name.endswith("y") else name + "ego"


_MEN_OF, _FAMILIES_OF = [_of(n) for n in _MEN], [_genitive(n) for n in _FAMILIES]
#: Numbers of the generator that a case may use.
PLACES = 4

# Category, what may not stay, what may not go, and the text; {list:n} draws from a list by the row's n-th number, and
# lists of one length that are drawn by one number go together.
LISTS = {"man": _MEN, "man_of": _MEN_OF, "woman": _WOMEN, "family": _FAMILIES, "family_of": _FAMILIES_OF, "rare": _RARE, "words": _WORDS}
CASES = (
    ("basic", "{family:1}", "umowę podpisał", "Wczoraj umowę podpisał {man:0} {family:1} w biurze."),
    ("inflected", "{family_of:1}", "w sprawie", "Pismo w sprawie {man_of:0} {family_of:1} wpłynęło."),
    ("rare", "{rare:1}", "zeznała", "Jako świadek {woman:0} {rare:1} zeznała inaczej."),
    ("dictionary", "{family:0}", "nie stawił", "wezwany {family:0} nie stawił się"),
    ("rare alone", "{rare:0}", "nie stawił", "wezwany {rare:0} nie stawił się"),
    ("structural", "jan{key}@firma.pl", "oraz adres", "numer {key} oraz adres jan{key}@firma.pl"),
    ("negative", "", "{words:0}", "Ustalono, że {words:0}."),
)


def _put(template: str, draw: Callable[[str, int], object], key: object, text: Callable[[str], object], join: Callable[[list], object]) -> object:
    """A template with its places filled in: as columns, or as SQL."""
    out = []
    for i, part in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            out.append(key if part == "key" else draw(part.split(":")[0], int(part.split(":")[1])))
        elif part:
            out.append(text(part))
    return join(out) if out else text("")


def cases(df: DataFrame, key: str) -> DataFrame:
    """Rows (id, category, must_mask, must_keep, text), one for each key; keys take the categories in turn."""
    given, k = F.col(key).cast("long"), F.col("id")
    drawn = df.select(given.alias("id"), *[random_number(given * PLACES + n).alias(f"n{n}") for n in range(2)])
    draw = lambda name, n: chosen(F.col(f"n{n}"), LISTS[name])
    put = lambda template: _put(template, draw, k.cast("string"), F.lit, lambda parts: F.concat(*parts))
    turn = k % len(CASES)
    by_turn = lambda column: F.coalesce(*[F.when(turn == i, put(row[column])) for i, row in enumerate(CASES)])
    listed = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return drawn.select("id", by_turn(0).alias("category"), listed(by_turn(1)).alias("must_mask"), listed(by_turn(2)).alias("must_keep"), by_turn(3).alias("text"))


def cases_sql(source: str, key: str, bits: Callable[[str], str]) -> str:
    """The same as SQL; ``bits`` gives the generator's number at a place."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    draw = lambda name, n: f"[{', '.join(map(quoted, LISTS[name]))}][1 + cast(floor(n{n} / 4294967296.0::double * {len(LISTS[name])}) as integer)]"
    put = lambda template: _put(template, draw, "k", quoted, " || ".join)
    by_turn = lambda column: f"case k % {len(CASES)} " + " ".join(f"when {i} then {put(row[column])}" for i, row in enumerate(CASES)) + " end"
    drawn = ", ".join(f"{bits(f'(k * {PLACES} + {n})')} as n{n}" for n in range(2))
    return f"select k as id, {by_turn(0)} as category, {by_turn(1)} as must_mask, {by_turn(2)} as must_keep, {by_turn(3)} as text from (select *, {drawn} from (select cast({key} as bigint) as k from {source}) a) b"


def measured(df: DataFrame, key: str) -> DataFrame:
    """Recall and precision by category, over a case for each key."""
    return evaluate.metrics(evaluate.evaluated(redact(cases(df, key))))
