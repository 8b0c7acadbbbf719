"""Forms of Polish names.

A word's readings are what it would be a form of, by one table of endings. Every question is a search among readings;
``readings`` gives them in the order of the table, so a word has one best reading whatever the register holds.
"""

from __future__ import annotations

from functools import cached_property, lru_cache
from typing import NamedTuple

from .dialect import rx
from .lexicon import DEFAULT, Lexicon

# Endings of first names in other cases than the first.
NAME_ENDINGS = ("a", "i", "y", "ie", "ę", "ą", "o", "u", "e", "em", "owi")
_NAME_ENDINGS, _NAME_LONGEST = frozenset(NAME_ENDINGS), max(map(len, NAME_ENDINGS))
# What follows the stem of adjectival surnames, and stems with an ending of their own in the plural.
ADJECTIVE_STEMS = "sk ck dzk".split()
ADJECTIVE_ENDINGS = "iego iemu imi ich im iej ą a".split()
PLURALS = {"ccy": "cki", "dzcy": "dzki", "scy": "ski"}
# Endings of other surnames, longest first.
NOUN_ENDINGS = "owie ował owi iem ami ach em om ów u a ą ę y o e".split()
# Vowels, and the least letters before a noun's ending for a known name and for any.
VOWELS, KNOWN_STEM, ANY_STEM = "aeiouąęóy", 3, 4
# Endings that mark surnames, and those of them that are not of the first case.
SURNAME_LIKE = r"(?:sk|ck|dzk)(?:i|a|iego|iej|iemu|im|imi|ich|ą)$|(?:scy|ccy|dzcy)$|icz(?:a|owi|em|owie|ami|ach)?$|czyk(?:a|owi|iem|ami|ach|owie)?$"
OBLIQUE = r"(?:sk|ck|dzk)(?:iego|iej|iemu|im|imi|ich|ą)$|icz(?:a|owi|em|owie|ami|ach)$|czyk(?:a|owi|iem|ami|ach|owie)$"


#: Surnames of which a process keeps all forms (some forty each); of a larger register readings are looked up.
KEPT = 20_000


#: What a word that is like a surname ends in.
LIKE_ENDINGS = tuple(a + b for a in ADJECTIVE_STEMS for b in "i a iego iej iemu im imi ich ą".split()) + tuple(PLURALS) + tuple(a + b for a in ("icz", "czyk") for b in ("", "a", "owi", "em", "iem", "owie", "ami", "ach"))


class Reading(NamedTuple):
    order: float
    base: str
    stem: str
    adjective: bool


def _table() -> dict[str, list[tuple[int, str, bool]]]:
    """For each ending its place in the order, what it becomes, and whether it is an adjective's."""
    rows = [(stem + e, stem + "i", True) for e in ADJECTIVE_ENDINGS for stem in ADJECTIVE_STEMS]
    rows += [(e, to, True) for e, to in PLURALS.items()] + [(e, "", False) for e in NOUN_ENDINGS]
    table: dict[str, list] = {}
    for order, (ending, to, adjective) in enumerate(rows):
        table.setdefault(ending, []).append((order, to, adjective))
    return table


_ENDINGS = _table()
_LONGEST = max(map(len, _ENDINGS))


def readings(word: str) -> list[Reading]:
    """What a lower-case word can be a form of; a stem that ends in two consonants may have lost an e between them."""
    out = []
    for cut in range(max(0, len(word) - _LONGEST), len(word)):
        stem = word[:cut]
        for order, to, adjective in _ENDINGS.get(word[cut:], ()):
            out.append(Reading(order, stem + to, stem, adjective))
            if not adjective and len(stem) > 1 and not set(stem[-2:]) & set(VOWELS):
                out.append(Reading(order + 0.5, f"{stem[:-1]}e{stem[-1]}", stem, False))
    return sorted(out)


def forms(base: str, least: int = KNOWN_STEM) -> set[str]:
    """All words that have a lower-case base among their readings, and itself; a noun's stem has ``least`` letters.

    The table of endings read the other way: an ending's words are the base without what the ending became, and it.
    """
    out = {base}
    for ending, rows in _ENDINGS.items():
        for _, to, adjective in rows:
            if adjective:
                if base.endswith(to) and len(base) > len(to):
                    out.add(base.removesuffix(to) + ending)
                continue
            if len(base) >= least:
                out.add(base + ending)
            stem = base[:-2] + base[-1:]  # without an e before the last letter
            if base[-2:-1] == "e" and len(stem) >= max(2, least) and not set(stem[-2:]) & set(VOWELS):
                out.add(stem + ending)
    return out


def name_forms(name_stems: frozenset[str], first_names: frozenset[str]) -> set[str]:
    """All words that count as first names."""
    return set(first_names) | {stem + ending for stem in name_stems if len(stem) > 1 for ending in NAME_ENDINGS}


def letters(index: int) -> str:
    """0 is A, 25 is Z, 26 is AA."""
    out, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def index_of(label: str) -> int:
    n = 0
    for c in label:
        n = n * 26 + ord(c) - 64
    return n - 1


class Names:
    """Questions about words, answered from a lexicon."""

    def __init__(self, lexicon: Lexicon = DEFAULT):
        self.lexicon = lexicon
        for name in ("is_first_name", "base", "key", "like_surname", "of_a_place"):
            setattr(self, name, lru_cache(100_000)(getattr(self, "_" + name)))

    @cached_property
    def forms(self) -> frozenset[str] | None:
        """All forms of the surnames, if these are few enough to keep them."""
        if len(self.lexicon.surnames) > KEPT:
            return None
        return frozenset().union(*map(forms, self.lexicon.surnames))

    def _is_first_name(self, word: str) -> bool:
        w, stems = word.lower(), self.lexicon.name_stems
        return w in self.lexicon.first_names or any(w[-k:] in _NAME_ENDINGS and w[:-k] in stems for k in range(1, min(_NAME_LONGEST, len(w) - 2) + 1))

    def _base(self, word: str) -> str | None:
        """A surname of the lexicon of which the word is a form."""
        w = word.lower()
        if len(w) < 3:
            return None
        if self.forms is not None and w not in self.forms:
            return None
        fit = (r.base for r in readings(w) if r.adjective or len(r.stem) >= KNOWN_STEM)
        return next((b for b in (w, *fit) if b in self.lexicon.surnames), None)

    def _key(self, word: str) -> str:
        """The same for all forms of a surname, known or not."""
        w = word.lower()
        fit = [r.base for r in readings(w) if r.adjective or (r.order % 1 == 0 and len(r.stem) >= ANY_STEM)]
        return self.base(w) or (fit or [w])[0]

    def _place_forms(self, w: str) -> list[bool]:
        """Whether a word, and each adjective of which it may be a form, belongs to a place."""
        return [x in self.lexicon.place_adjectives for x in (w, *(r.base for r in readings(w) if r.adjective))]

    def _of_a_place(self, word: str) -> bool:
        return any(self._place_forms(word.lower()))

    def _like_surname(self, word: str) -> bool:
        w = word.lower()
        return len(w) >= 5 and bool(rx(SURNAME_LIKE).search(w)) and not any(self._place_forms(w)[:2])

    def is_surname(self, word: str) -> bool:
        return bool(self.base(word)) or self.like_surname(word)
