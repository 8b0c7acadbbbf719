"""The redaction of one text: all rules in order over one state.

Rules depend on what earlier ones left (a masked street anchors the place beside it), so they are one fold and not a
chain of columns; ``redact`` runs the fold once for each Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache
from operator import methodcaller

from ..functions.dialect import once, rx
from ..functions.lexicon import DEFAULT, EMPTY_VALUES, LABEL_WORDS, Lexicon
from ..functions.morphology import Names, index_of, letters
from . import rules as R
from .ledger import Edit, Ledger, rewritten
from .persons import Persons, Places, tags_of
from .prefilter import Facts, Need, either, need

_OPEN, _CLOSE = chr(0xE000), chr(0xE001)
_PARTICLE = r"^(m|lok|ul|al|os|pl|nr|im|św|gen|ks)\.?$"
_NAME = r"\p{L}[\p{L}'’.‑-]*"


#: Kinds up to which a text's words are not looked up for the rules' strings.
FEW = 8


class State:
    """A text while rules change it. ``ledger`` follows where its masks stood, if asked for."""

    def __init__(self, text: str, types: frozenset | None, masks: Mapping[str, str], names: Names, pseudonyms: bool, ledger: Ledger | None = None, guarded: bool = True):
        self.text = self.raw = text
        self.types, self.masks, self.names, self.ledger = types, masks, names, ledger
        self.counts: dict[str, int] = {}
        self.labels: dict[str, str] | None = {} if pseudonyms else None
        self.few = types is not None and len(types) <= FEW
        self.given = False  # labels that other texts have as well
        self.guarded = guarded  # Polish words before a match (ust., wersja, ver) can say that it is none
        self.urls: list[tuple[str, int, list[Edit]]] = []
        self._facts = None

    def may(self, need: Need | None) -> bool:
        """Whether the text holds what each match of a rule holds."""
        if self._facts is None or self._facts.text is not self.text:
            self._facts = Facts(self.text, tags_of(self.names).known, self.few)
        return need is None or need.met(self._facts)

    def edit(self, edits: list[Edit]) -> None:
        """Changes the text; edits are in order and do not overlap."""
        if edits := [e for e in edits if self.text[e[0] : e[1]] != e[2]]:
            self.text = rewritten(self.text, edits)
            if self.ledger is not None:
                self.ledger.record(edits)

    def on(self, kind: str) -> bool:
        return self.types is None or kind in self.types

    def hit(self, kind: str) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + 1

    def mask(self, kind: str) -> str:
        self.hit(kind)
        return self.masks[kind]

    def person(self, surname: str) -> str:
        if self.labels is None:
            return self.masks["IMIE"]
        return f"[OSOBA-{self.labels.setdefault(self.names.key(surname), letters(len(self.labels)))}]"

    def found(self, rule: R.Rule, before: str) -> list[Edit]:
        """What a rule changes in a text."""
        out = []
        for m in rule.regex.finditer(before):
            if self.guarded and (rule.not_after_reference and R.after_reference(before, m.start()) or rule.beside and not rule.beside(m, before)):
                continue
            if rule.allow and not rule.allow(m, before):
                continue
            mask, at, new = self.mask(rule.type), m.start(), ""
            for c in rule.keep:
                if not c.isdigit():
                    new += mask if c == "*" else c
                elif m.start(int(c)) >= 0:
                    out.append((at, m.start(int(c)), new))
                    at, new = m.end(int(c)), ""
            out.append((at, m.end(), new))
        return out

    def apply(self, rule: R.Rule) -> None:
        text, facts, asked = self.text, self._facts, rule.need
        if self.types is not None and rule.type not in self.types:
            return
        if facts is not None and facts.text is text:
            if asked is not None and not asked.met(facts):
                return
        elif not self.may(asked):
            return
        if not rule.needs or rule.needs(self.raw):
            self.edit(self.found(rule, text))


# Links

_IN_URLS = (
    R.Rule("EMAIL", R.EMAIL, always=True),
    R.Rule("EMAIL", R.EMAIL.replace("@", "%40"), always=True),
    R.Rule("TOKEN", R.JWT, always=True),
    R.Rule("KSEF", R.KSEF, allow=R.is_ksef, needs=R.ksef_named, always=True),
    *(R.Rule(kind, pattern, "1*", True, always=True) for kind, pattern in R.URL_PARAMETERS),
)
_URL, _STAND_IN = Need(signs=("http", "www."), strings=("http", "www.")), f"{_OPEN}([A-Z]+){_CLOSE}"


def hide_urls(s: State) -> None:
    """Masks within links, then puts a stand-in for each, which no rule touches."""
    if not s.may(_URL):
        return
    edits = []
    for m in rx(R.URL).finditer(s.text):
        url = rx(r"[.,;:!?\]]+$").sub("", m.group())
        inner = State(url, s.types, s.masks, s.names, False, Ledger())
        inner.raw, inner.counts = s.raw, s.counts
        for rule in _IN_URLS:
            inner.apply(rule)
        s.urls.append((inner.text, m.start(), inner.ledger.stretches))
        edits.append((m.start(), m.start() + len(url), f"{_OPEN}{letters(len(s.urls) - 1)}{_CLOSE}"))
    s.edit(edits)


def show_urls(s: State) -> None:
    if s.urls:
        known = ((m, index_of(m[1])) for m in rx(_STAND_IN).finditer(s.text))
        places = [(m.start(), m.end(), i) for m, i in known if i < len(s.urls)]
        s.edit([(a, b, s.urls[i][0]) for a, b, i in places])
        if s.ledger is not None:
            s.ledger.open([(a, b, *s.urls[i]) for a, b, i in places])


# Forms


def _empty(value: str) -> bool:
    return rx(r"\s+").sub("", value.lower()).removesuffix(".") in EMPTY_VALUES


def fits(value: str, kind: str) -> bool:
    """Whether a text can be the value of a field."""
    t = value.strip()
    if not t or len(t) > 70 or _empty(t) or rx(r"^\d+[.)]\s").search(t) or rx(r"^(nie\b|nieznan|niepodan|do ustalenia|brak\b|b/d)", True).search(t):
        return False
    if kind == "place":
        return bool(rx(rf"^\p{{Lu}}{_NAME[5:]}(?:[ \t]+\p{{Lu}}{_NAME[5:]}){{0,3}}$").search(t))
    if kind == "name":
        return bool(rx(rf"^{_NAME}(?:[ \t]+{_NAME}){{0,3}}$").search(t))
    if kind == "date":
        return bool(rx(r"\d{4}|\d{1,2}[-./]\d{1,2}").search(t))
    parts = rx(r"\s+").split(t)
    return len(parts) <= 5 and bool(rx(r"^[\p{Lu}\d]").search(t)) and all(rx(r"^\p{Lu}").search(w) or rx(r"\d").search(w) or rx(_PARTICLE, True).search(w) for w in parts)


def _label(line: str) -> str:
    return rx(r"^[ \t]*\d+[.)][ \t]*").sub("", line).strip()


def _field(label: str):
    return next(((kind, sort) for pattern, kind, sort in R.FORM_FIELDS if rx(pattern, True).search(label)), None)


def is_label(line: str) -> bool:
    base = rx(r"\s*:\s*$").sub("", _label(line))
    if _field(base) or rx(r":\s*$").search(line) or rx(r"^\d+[.)]\s+\S").search(line.strip()):
        return True
    words = rx(r"\s+").split(base)
    return len(words) <= 3 and words[0].lower() in LABEL_WORDS


_FIELDS = tuple((kind, need(pattern)) for pattern, kind, _ in R.FORM_FIELDS)
_ANY_FIELD = either(asked for _, asked in _FIELDS)


def forms(s: State) -> None:
    """Values beside or below the labels of form fields. Their masks are the standard ones."""
    if not s.may(_ANY_FIELD) or not any(s.on(kind) and s.may(asked) for kind, asked in _FIELDS):
        return
    lines, known = s.text.split("\n"), tags_of(s.names).known
    for i, line in enumerate(lines):
        if not _ANY_FIELD.met(Facts(line, known, True)):
            continue
        bare = _label(line)
        found = _field(rx(r"\s*\([^)]*\)\s*$").sub("", rx(r"\s*:.*$").sub("", bare, count=1), count=1))
        if not found or not s.on(found[0]):
            continue
        kind, sort = found
        if m := rx(r":\s*(.+)$").search(bare):
            value = m[1].strip()
            if sort != "date" and fits(value, sort):
                place = once(rf"{R.escaped(value)}\s*$").search(lines[i])
                _in_line(s, lines, i, place and place.span(), kind)
            continue
        j = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and not rx(r"^\(.*\)$").search(lines[j].strip())), None)
        if j is None or is_label(lines[j]) or not fits(lines[j], sort):
            continue
        if sort != "date":
            body = lines[j].strip()
            at = lines[j].index(body)
            _in_line(s, lines, j, (at, at + len(body)), kind)
        elif date := rx(R.DATE, True).search(lines[j]):
            _in_line(s, lines, j, date.span(), kind)


def _in_line(s: State, lines: list[str], i: int, span: tuple[int, int] | None, kind: str) -> None:
    """Masks a part of a line, which takes the standard mask."""
    s.hit(kind)
    if span:
        at, edit = sum(len(x) + 1 for x in lines[:i]), (*span, R.MASKS[kind])
        s.edit([(at + span[0], at + span[1], R.MASKS[kind])])
        lines[i] = rewritten(lines[i], [edit])


# Fields of XML and JSON, which need not be well formed

_SHAPES = {
    "postal": r"^\d{2}[- ]?\d{3}$",
    "birth": R.DATE,
    "login": r"^[A-Za-z][A-Za-z0-9._@-]{1,63}$",
    "email": r"\S(?:@|%40|\(at\))\S",
    "pesel": r"^\d(?:[ -]?\d){10}$",
    "nip": r"^(?:PL[- ]?)?\d(?:[ -]?\d){9}$",
    "regon": r"^\d(?:[ -]?\d){8}(?:(?:[ -]?\d){5})?$",
}


def struct_mask(s: State, kind: str, value: str) -> str | None:
    v = value.strip()
    if not v or len(v) > 70 or any(c in v for c in f"[]{_OPEN}{_CLOSE}") or _empty(v):
        return None
    words = rx(r"\s+").split(v)
    if kind in ("first", "surname", "fullname", "name"):
        ok = fits(v, "name") and (kind != "name" or s.names.is_first_name(words[0]) or s.names.is_surname(words[-1]))
    elif kind in ("city", "addr"):
        ok = fits(v, "place" if kind == "city" else "addr")
    elif kind == "phone":
        ok = sum("0" <= c <= "9" for c in v) >= 6 and not rx(r"[A-Za-z]{3,}").search(v)
    else:
        ok = bool(rx(_SHAPES[kind], kind in ("birth", "email")).search(v))
    if not ok or not s.on(R.STRUCT_TYPES[kind]):
        return None
    s.hit(R.STRUCT_TYPES[kind])
    if kind in ("surname", "fullname") or (kind == "name" and len(words) > 1):
        return s.person(words[-1])
    return s.masks[R.STRUCT_TYPES[kind]]


_XML = r"(<([A-Za-z_][\w.-]{0,40})(?:\s[^<>]*)?>)([^<>\r\n]{1,70})(</\s*\2\s*>)"
_JSON = r'("([A-Za-z_][\w.-]{0,40})"\s*:\s*")([^"\r\n]{1,70})(")'
_STRUCTURED = ((_XML, Need(signs=("</",))), (_JSON, Need(hint=re.compile(r'"\s*:\s*"'))))


def structured(s: State) -> None:
    for pattern, asked in _STRUCTURED:
        if not s.may(asked):
            continue
        edits = []
        for m in rx(pattern).finditer(s.text):
            kind = R.KIND_OF_KEY.get(R.struct_key(m[2]))
            if mask := kind and struct_mask(s, kind, m[3]):
                edits.append((*m.span(3), mask))
        s.edit(edits)


_LOGIN = (
    r"((?:\b[Ll]ogin\w{0,3}|\b[Uu]ser(?:name)?|\b[Nn]azwa\s+użytkownika|\b[Ii]dentyfikator\s+użytkownika)(?:\s+(?:użytkownika|administratora|operatora|serwisow\w+|techniczn\w+|w\s+systemie|systemow\w+|domenow\w+|sieciow\w+))?[ \t]*[:=][ \t]*\n?[ \t]*)"
    r"""(["„'«]?)([A-Za-z][A-Za-z0-9._-]{1,62}[A-Za-z0-9])(?!\.?[\p{L}\p{N}_-])(["”'»]?)"""
)
_LOGIN_QUOTED = r"""\b([Uu]żytkownik\w*|[Ll]ogin\w*|[Kk]onto[ \t]+użytkownika)([ \t]+["„'«])([A-Za-z][A-Za-z0-9._-]{2,63})(["”'»])"""
_LOGIN_WORDS = need(r"(?:[Ll]ogin|[Uu]ser|[Uu]żytkownik)")


def _is_login(m, text: str) -> bool:
    if (m[2] and not m[4]) or (not m[4] and text[m.end() : m.end() + 1] == ":"):
        return False
    if "\n" in m[1]:
        stop = text.find("\n", m.start() + len(m[1]))
        if not rx(r"^[\s.,;]*$").search(text[m.end() : len(text) if stop < 0 else stop]):
            return False
    return m[3].lower() not in EMPTY_VALUES and m[3].lower() not in LABEL_WORDS


def logins(s: State) -> None:
    """Values after a login's label, then the same values wherever else they stand."""
    if not s.on("LOGIN") or not s.may(_LOGIN_WORDS):
        return
    seen: dict[str, None] = {}
    for pattern, fit in ((_LOGIN, _is_login), (_LOGIN_QUOTED, lambda m, text: True)):
        hits = [m for m in rx(pattern).finditer(s.text) if fit(m, s.text)]
        seen.update(dict.fromkeys(m[3] for m in hits if len(m[3]) >= 4))
        s.edit([(*m.span(3), s.mask("LOGIN")) for m in hits])
    for value in seen:
        s.edit([(*m.span(), s.mask("LOGIN")) for m in once(rf"(?<![\w.-]){R.escaped(value)}(?![\w.-])").finditer(s.text)])


_PHONES = need(R.PHONE_LISTS, chain=9)


def phone_lists(s: State) -> None:
    """Numbers after a phone's label; in a list all must be numbers, or none is masked."""

    def valid(part):
        d = rx(r"\D").sub("", part)
        return len(d) == 9 or (len(d) == 11 and d.startswith("48"))

    if not s.on("TELEFON") or not s.may(_PHONES):
        return
    edits = []
    for m in rx(R.PHONE_LISTS, True).finditer(s.text):
        if all(map(valid, rx(R.PHONE_JOIN, True).split(m[3]))):
            for n in rx(R.PHONE_DIGITS).finditer(m[3]):
                lead = len(n.group()) - len(n.group().lstrip())
                edits.append((m.start(3) + n.start() + lead, m.start(3) + n.end(), s.mask("TELEFON")))
    s.edit(edits)


def plate_lists(s: State) -> None:
    """Number plates listed after a masked one."""
    mask = s.masks["NR-REJESTRACYJNY"]
    if not s.on("NR-REJESTRACYJNY") or mask not in s.text:
        return
    lists = rx(rf"({R.escaped(mask)})((?:(?:\s*,\s*|\s+oraz\s+|\s+i\s+){R.PLATE}(?![\w-]))+)").finditer(s.text)
    plates = [(m.start(2) + p.start(), m.start(2) + p.end()) for m in lists for p in rx(R.PLATE).finditer(m[2]) if p.group()[0] in R.PLATE_LETTERS]
    s.edit([(*p, s.mask("NR-REJESTRACYJNY")) for p in plates])


def renumber(s: State) -> None:
    """Persons' labels in the order in which they stand."""
    order: dict[str, str] = {}
    if "[OSOBA-" in s.text:
        s.edit([(*m.span(), f"[OSOBA-{order.setdefault(m[1], letters(len(order)))}]") for m in rx(r"\[OSOBA-([A-Z]+)\]").finditer(s.text)])


def bare_addresses(s: State) -> None:
    """Addresses and postal codes that only a mask beside them gives away."""
    if s.masks["KOD-POCZTOWY"] in s.text:
        s.apply(R.untyped_address(s.masks["KOD-POCZTOWY"]))
    if s.masks["ADRES"] in s.text:
        s.apply(R.bare_postal(s.masks["ADRES"]))


def places(s: State) -> None:
    if s.on("MIEJSCOWOSC"):
        Places(s).run()


def persons(s: State) -> None:
    found = Persons(s)
    if s.on("IMIE"):
        found.run()
    found.close()
    if not s.given:
        renumber(s)


_STEPS = (
    hide_urls, *R.IDENTITY, forms, structured, logins, *R.REFERENCES, *R.NUMBERS_1, phone_lists, *R.NUMBERS_2, plate_lists,
    *R.POSTAL, *R.DATES, *R.ADDRESSES, bare_addresses, places, persons, show_urls,
)


@lru_cache(1000)
def _steps(types: frozenset | None) -> tuple[tuple[Callable[[State], None], ...], int]:
    """The steps for the kinds that are wanted, and the first after which none reads the text as it stood at the start."""
    steps = [x for x in _STEPS if not isinstance(x, R.Rule) or types is None or x.type in types]
    free = max((i for i, x in enumerate(steps) if isinstance(x, R.Rule) and x.needs), default=0)
    return tuple(methodcaller("apply", x) if isinstance(x, R.Rule) else x for x in steps), free


#: What became of a text from a step on: (step, text, persons' labels so far) to the redacted text and the counts that were added.
Onward = dict[tuple[int, str, tuple], tuple[str, dict[str, int]]]
#: So many texts are kept, of at most so many characters.
KEPT, SHORT = 10_000, 1_000


def _added(counts: dict[str, int], more: dict[str, int]) -> dict[str, int]:
    return counts | {kind: counts.get(kind, 0) + n for kind, n in more.items()}


def _folded(s: State, onward: Onward | None = None) -> State:
    """A state after all rules.

    With ``onward``, texts that a step has made equal (forms in which only masked numbers differ) go on once: what follows
    depends on the text, the labels and what all texts share. Texts with links, whose insides are kept apart, go on alone.
    """
    steps, free = _steps(s.types)
    last, begun = s.text, []
    for i, step in enumerate(steps):
        step(s)
        if onward is not None and s.text is not last and i >= free and not s.urls:
            last = s.text
            if len(last) > SHORT:
                continue
            key = i, last, tuple(s.labels.items()) if s.labels else ()
            if known := onward.get(key):
                s.text, s.counts = known[0], _added(s.counts, known[1])
                break
            begun.append((key, s.counts))
            s.counts = {}
    if begun and len(onward) > KEPT:
        onward.clear()
    for key, before in reversed(begun):
        onward[key] = s.text, s.counts
        s.counts = _added(before, s.counts)
    return s


def _state(text, types, masks, pseudonyms, names, ledger=None, guarded=True, onward=None) -> State:
    return _folded(State(text, None if types is None else frozenset(types), {**R.MASKS, **(masks or {})}, names or _names(DEFAULT), pseudonyms, ledger, guarded), onward)


def redact_text(text, types: Iterable[str] | None = None, masks: Mapping[str, str] | None = None, pseudonyms: bool = False, names: Names | None = None, guarded: bool = True, onward: Onward | None = None) -> tuple[str, list[tuple[str, int]]]:
    """A text without personal data, and how many of each kind it held, in the order in which kinds were first met.

    Words that in Polish say a number is none of a kind (ust., poz., wersja, ver) are heeded unless ``guarded`` is false.
    ``onward`` is shared by texts for which all other arguments are the same.
    """
    if not text:
        return "", []
    s = _state(text, types, masks, pseudonyms, names, None, guarded, onward)
    return s.text, list(s.counts.items())


def redact_with_labels(text, labels: dict[str, str], types: Iterable[str] | None = None, names: Names | None = None) -> tuple[str, list[tuple[str, int]]]:
    """As ``redact_text`` with persons told apart, by labels that are shared with other texts.

    ``labels`` (a person's key to letters) gains those who are new, in the order in which they stand.
    """
    if not text:
        return "", []
    s = State(text, None if types is None else frozenset(types), R.MASKS, names or _names(DEFAULT), True)
    s.given, s.labels = True, dict(labels)
    _folded(s)
    new = {s.labels[k]: k for k in s.labels.keys() - labels.keys()}
    order = [m[1] for m in rx(r"\[OSOBA-([A-Z]+)\]").finditer(s.text) if m[1] in new]
    order += sorted(new.keys() - set(order), key=index_of)  # named, but taken into another mask since
    named = {old: letters(len(labels) + i) for i, old in enumerate(dict.fromkeys(order))}
    s.edit([(*m.span(1), named[m[1]]) for m in rx(r"\[OSOBA-([A-Z]+)\]").finditer(s.text) if m[1] in named])
    labels.update({new[old]: label for old, label in named.items()})
    return s.text, list(s.counts.items())


def masked_places(text, types: Iterable[str] | None = None, masks: Mapping[str, str] | None = None, pseudonyms: bool = False, names: Names | None = None) -> list[tuple[str, str, int, int]]:
    """Each mask that redaction puts in: mask, what it takes the place of, and where that stands in the text.

    The places are those of the rules' own edits. A mask that took in words beside it stands for them as well; masks
    of which one replaced another's surroundings stand for the same stretch. Masks given as empty texts are left out.
    """
    if not text:
        return []
    s = _state(text, types, masks, pseudonyms, names, Ledger())
    known = rx("|".join([r"\[OSOBA-[A-Z]+\]", *sorted({R.escaped(m) for m in (*s.masks.values(), *R.MASKS.values()) if m}, key=len, reverse=True)]))
    return [(m.group(), text[x.first_start : x.first_end], x.first_start, x.first_end) for x in s.ledger.stretches for m in known.finditer(s.text, x.start, x.end)]


_known: dict[Lexicon, Names] = {}


def _names(lexicon: Lexicon) -> Names:
    if lexicon not in _known:
        _known[lexicon] = Names(lexicon)
    return _known[lexicon]
