"""Which rules can match a text at all, from one pass over its words and one over its digits.

What every match of a pattern must hold is read off the pattern itself: strings of which each match has one, and how
many digits stand side by side in it. The letters of such strings lie within one word, so a word is looked up once for
all rules, its answer a set of bits that a process remembers; a text's bits are those of its different words. A rule is
tried only where its bits, digits and other signs are there, and again only once an earlier mask has changed the text.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache

from ..functions.dialect import LO, UP, translated

#: Strings that a pattern's alternatives may expand to, and letters from which on a string is looked up by word.
EXPANDED, BY_WORD = 64, 3
#: What stands between white space is remembered up to so many, each of at most so many characters.
REMEMBERED, LONGEST = 400_000, 64
#: Runs of digits this near to each other, with no letter between, make a chain.
NEAR = 3
_WORD = re.compile(f"[{UP}{LO}]+(?:-[{UP}{LO}]+)*")
_LETTERS = re.compile(f"[{UP}{LO}]+")
_DIGITS = re.compile("[0-9]+")
_CHAINS = re.compile(f"[0-9]+(?:[^0-9{UP}{LO}]{{1,{NEAR}}}[0-9]+)*")
_MIXED, _BESIDE = (re.compile(f"[0-9](?:[{x}]|(?<=[{x}][0-9]))") for x in ("A-Z", UP + LO))
#: Sets of facts up to which it is remembered which needs they meet.
VERDICTS = 1_000
#: Letters beyond the words' that a case-insensitive pattern takes for an ASCII one.
_FOLDED = "\u017f\u212a"


@dataclass(frozen=True)
class Held:
    """A part of a pattern: all its strings if they are few, else strings of which it holds one; its digits side by side, and if it is nothing else."""

    exact: frozenset[str] | None = None
    one_of: frozenset[str] | None = None
    digits: int = 0
    solid: bool = False


_NOTHING = Held(frozenset([""]), solid=True)


def _worth(strings: frozenset[str]) -> tuple[int, int]:
    return min(2 * max((len(x) for x in _LETTERS.findall(s)), default=0) or len(s.strip()) for s in strings), -len(strings)


def _best(*sets: frozenset[str] | None) -> frozenset[str] | None:
    """The strings that say most, of sets in which none is blank."""
    return max((s for s in sets if s and all(x.strip() for x in s)), key=_worth, default=None)


def _class(items) -> Held:
    """Characters that are few and named one by one, or digits."""
    if all(str(k) == "LITERAL" for k, _ in items) and len(found := {chr(v).lower() for _, v in items}) <= 4:
        exact = frozenset(found)
        return Held(exact, exact)
    solid = all(str(k) == "RANGE" and v == (48, 57) for k, v in items)
    return Held(digits=int(solid), solid=solid)


def _part(kind: str, value) -> Held:
    if kind == "LITERAL":
        c = frozenset([chr(value).lower()])
        return Held(c, c, int(48 <= value <= 57), 48 <= value <= 57)
    if kind == "IN":
        return _class(value)
    if kind in ("SUBPATTERN", "ATOMIC_GROUP"):
        return _sequence(value[3] if kind == "SUBPATTERN" else value)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, item = value
        inner = _sequence(item)
        if least == most == 1:
            return inner
        if not least:
            return Held(inner.exact | {""} if most == 1 and inner.exact else None)
        return Held(None, _best(inner.exact, inner.one_of), inner.digits * least if inner.solid else inner.digits, inner.solid)
    if kind == "BRANCH":
        sides = [_sequence(s) for s in value[1]]
        exact = frozenset().union(*(s.exact for s in sides)) if all(s.exact for s in sides) else None
        needs = [_best(s.exact, s.one_of) for s in sides]
        return Held(exact if exact and len(exact) <= EXPANDED else None, frozenset().union(*needs) if all(needs) else None, min(s.digits for s in sides), all(s.solid for s in sides))
    return _NOTHING if kind in ("ASSERT", "ASSERT_NOT", "AT") else Held()


def _sequence(items) -> Held:
    run, found, digits, side, solid = frozenset([""]), [], 0, 0, True
    for kind, value in items:
        part = _part(str(kind), value)
        side = side + part.digits if part.solid else 0
        digits, solid = max(digits, side, part.digits), solid and part.solid
        if part.exact and len(run) * len(part.exact) <= EXPANDED:
            run = frozenset(a + b for a in run for b in part.exact)
        else:
            found += [run, part.exact, part.one_of]
            run = frozenset([""])
    return Held(None if found else run, _best(run, *found), digits, solid)


@cache
def held(pattern: str) -> Held:
    """What each match holds, lower-case. A property of letters (and a class with one) is any character here."""
    plain = translated(pattern)
    if "\\p" in plain:
        plain = re.sub(r"\\p\{\w+\}", "[^\x00]", re.sub(r"\[[^\]]*\\p\{\w+\}[^\]]*\]", "[^\x00]", plain))
    return _sequence(parser.parse(plain))


class Strings:
    """A bit for each string that rules ask for by word, found by their first letters at each place of a word."""

    def __init__(self):
        self.bit: dict[str, int] = {}
        self.begun: dict[str, list[str]] = {}

    def of(self, strings: frozenset[str]) -> tuple[int, tuple[str, ...]]:
        """Bits and signs: a text that holds one of the strings has one of the bits or one of the signs."""
        bits, signs = 0, []
        for s in sorted(strings):
            longest = max(_LETTERS.findall(s), key=len, default="")
            if len(longest) < BY_WORD:
                signs.append(s)
                continue
            if longest not in self.bit:
                self.bit[longest] = len(self.bit)
                self.begun.setdefault(longest[:BY_WORD], []).append(longest)
            bits |= 1 << self.bit[longest]
        return bits, tuple(signs)

    def within(self, word: str) -> int:
        low, bits, begun = word.lower(), 0, self.begun
        for i in range(len(low) - BY_WORD + 1):
            if low[i : i + BY_WORD] in begun:
                for s in begun[low[i : i + BY_WORD]]:
                    if low.startswith(s, i):
                        bits |= 1 << self.bit[s]
        return bits


STRINGS = Strings()


#: All signs that needs ask for, as keys.
SIGNS: dict[str, None] = {}


@dataclass(frozen=True, eq=False)
class Need:
    """What a text must hold for a rule: one of ``words`` or ``signs``, all of one of ``names``, so many digits, a quick pattern."""

    words: int = 0
    signs: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()  # what the words' bits and the signs stand for
    names: tuple[int, ...] = ()
    digits: int = 0
    chain: int = 0
    mixed: bool = False
    hint: re.Pattern | None = None

    signs_by: int = field(default=0, init=False)  # its signs are among so many that were asked for first

    def __post_init__(self):
        SIGNS.update(dict.fromkeys(self.signs))
        object.__setattr__(self, "signs_by", len(SIGNS))

    def met(self, facts: Facts) -> bool:
        if facts.direct:
            return self._met(facts) and (not self.hint or bool(self.hint.search(facts.text)))
        verdicts = facts.verdicts
        found = verdicts.get(self)
        if found is None:
            found = self._met(facts)
            if self.words.bit_length() <= facts.shared_bits and self.signs_by <= facts.shared_signs:
                verdicts[self] = found
        return found and (not self.hint or bool(self.hint.search(facts.text)))

    def _met(self, facts: Facts) -> bool:
        """Whether a text's facts allow a match, the quick pattern apart."""
        if self.digits > facts.run or self.chain > facts.chain or (self.mixed and not facts.mixed):
            return False
        if facts.direct and self.strings:
            if not any(s in facts.low for s in self.strings):
                return False
        elif self.words or self.signs:
            bits = facts.bits_of(self.words) if self.words else 0
            if not (bits & self.words or bits < 0 or any(s in facts.low for s in self.signs) or any(c in facts.text for c in _FOLDED)):
                return False
        return not self.names or any(facts.names & n == n for n in self.names)


def either(needs: Iterable[Need]) -> Need:
    """What texts hold that meet one of some needs of strings alone."""
    needs = tuple(needs)
    if not all(n.words or n.signs for n in needs):
        return Need()
    words = 0
    for n in needs:
        words |= n.words
    return Need(words, tuple(dict.fromkeys(s for n in needs for s in n.signs)), tuple(dict.fromkeys(s for n in needs for s in n.strings)))


@cache
def need(pattern: str, chain: int = 0, mixed: bool = False, hint: str | None = None, names: tuple[int, ...] = ()) -> Need:
    found = held(pattern)
    words, signs = STRINGS.of(_best(found.exact, found.one_of) or frozenset())
    strings = tuple(dict.fromkeys(max(_LETTERS.findall(s), key=len, default="") if words and s not in signs else s for s in sorted(_best(found.exact, found.one_of) or ())))
    return Need(words, signs, strings, names, found.digits, chain, mixed, re.compile(hint) if hint else None)


_verdicts: dict[tuple, dict[Need, bool]] = {}


class Facts:
    """A text's facts, each worked out when it is first asked for. ``direct``: strings are looked for one by one, as for few rules."""

    def __init__(self, text: str, known: Known, direct: bool = False):
        self.text, self._known, self.direct = text, known, direct and not any(c in text for c in _FOLDED)

    def __getattr__(self, name):
        if name in ("bits", "words_names", "seen"):
            self.seen = len(STRINGS.bit)
            self.bits, self.words_names = self._known.of(self.text)
        elif name in ("run", "chain", "mixed", "beside"):
            self._digits()
        elif name == "names":
            self.names = self.words_names | (self._known.beside if self.beside else 0)
        elif name == "low":
            self.low = self.text.lower()
        elif name == "verdicts":
            self.verdicts = self._shared()
        else:
            raise AttributeError(name)
        return self.__dict__[name]

    def bits_of(self, asked: int) -> int:
        """The bits of the text's strings; worked out anew if a rule asks for strings that were unknown then."""
        if asked.bit_length() > self.seen:
            del self.bits, self.seen
        return self.bits

    def _shared(self) -> dict[Need, bool]:
        """The needs that are known to be met or not, for all texts of the same facts."""
        bits, names, low = self.bits, self.words_names, self.low
        self._digits()
        self.names = names = names | (self._known.beside if self.beside else 0)
        self.shared_bits, self.shared_signs = self.seen, len(SIGNS)
        key = bits, self.seen, names, self.run, self.chain, self.mixed, len(SIGNS), tuple([s for s in SIGNS if s in low])
        found = _verdicts.get(key)
        if found is None:
            if len(_verdicts) >= VERDICTS:
                _verdicts.clear()
            found = _verdicts[key] = {}
        return found

    def _digits(self) -> None:
        """The longest run and the longest chain of digits; whether a capital, and whether a letter stands beside one."""
        text, run, longest = self.text, 0, 0
        for chain in _CHAINS.findall(text):
            if len(chain) > run:
                sizes = [len(chain)] if chain.isascii() and chain.isdigit() else [*map(len, _DIGITS.findall(chain))]
                run, longest = max(run, *sizes), max(longest, sum(sizes))
        self.run, self.chain = run, longest
        self.beside = run > 0 and bool(_BESIDE.search(text))
        self.mixed = self.beside and bool(_MIXED.search(text))


@dataclass
class Known:
    """Bits of what stands between white space, remembered. ``tags`` gives a word's own facts; ``beside`` is the one of texts with letters beside digits."""

    tags: Callable[[str], int]
    beside: int = 0
    plain: set[str] = field(default_factory=set)  # without any bit
    other: dict[str, tuple[int, int]] = field(default_factory=dict)
    strings: int = 0

    def of(self, text: str) -> tuple[int, int]:
        if any(c in text for c in _FOLDED):
            return -1, -1
        if len(self.plain) + len(self.other) > REMEMBERED or self.strings != len(STRINGS.bit):
            self.plain.clear()
            self.other.clear()
            self.strings = len(STRINGS.bit)
        bits = names = 0
        for chunk in set(text.split()).difference(self.plain):
            found = self.other.get(chunk) or self._new(chunk)
            bits |= found[0]
            names |= found[1]
        return bits, names

    def _new(self, chunk: str) -> tuple[int, int]:
        bits = names = 0
        for w in _WORD.findall(chunk):
            bits |= STRINGS.within(w)
            names |= self.tags(w)
        if len(chunk) <= LONGEST:
            if bits or names:
                self.other[chunk] = bits, names
            else:
                self.plain.add(chunk)
        return bits, names
