"""Rules for structured personal data: a pattern, what of it stays, and what may forbid it.

A rule is data. The engine (``fold``) runs the rules of a phase in order over one text; each sees what the ones before
it left, and its guards see the text as it was when the rule began.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as check
from ..functions.dialect import CAP_PLACE, LO, UP, rx
from ..functions.lexicon import CURRENCIES, PLATE_LETTERS
from .prefilter import Need, need

# Kinds of personal data, their masks and their names for people.
MASKS = {
    "EMAIL": "[EMAIL]",
    "IBAN": "[NR-KONTA]",
    "NR-KONTA": "[NR-KONTA]",
    "KARTA": "[NR-KARTY]",
    "PESEL": "[PESEL]",
    "NIP": "[NIP]",
    "REGON": "[REGON]",
    "TELEFON": "[TELEFON]",
    "DOWOD": "[NR-DOWODU]",
    "PASZPORT": "[NR-PASZPORTU]",
    "KRS": "[KRS]",
    "KSEF": "[NR-KSEF]",
    "PRAWO-JAZDY": "[PRAWO-JAZDY]",
    "NR-REJESTRACYJNY": "[NR-REJESTRACYJNY]",
    "VIN": "[VIN]",
    "IP": "[IP]",
    "MAC": "[MAC]",
    "TOKEN": "[TOKEN]",
    "LOGIN": "[LOGIN]",
    "ZNAK-SPRAWY": "[ZNAK-SPRAWY]",
    "KOD-POCZTOWY": "[KOD-POCZTOWY]",
    "DATA-UR": "[DATA-URODZENIA]",
    "ADRES": "[ADRES]",
    "MIEJSCOWOSC": "[MIEJSCOWOŚĆ]",
    "IMIE": "[IMIĘ I NAZWISKO]",
}
LABELS = {
    "EMAIL": "adres e-mail",
    "IBAN": "numer konta",
    "NR-KONTA": "numer konta",
    "KARTA": "numer karty płatniczej",
    "PESEL": "PESEL",
    "NIP": "NIP",
    "REGON": "REGON",
    "TELEFON": "numer telefonu",
    "DOWOD": "numer dowodu",
    "PASZPORT": "numer paszportu",
    "KRS": "numer KRS",
    "KSEF": "numer KSeF",
    "PRAWO-JAZDY": "nr prawa jazdy",
    "NR-REJESTRACYJNY": "nr rejestracyjny",
    "VIN": "VIN",
    "IP": "adres IP",
    "MAC": "adres MAC",
    "TOKEN": "token",
    "LOGIN": "login",
    "ZNAK-SPRAWY": "znak sprawy",
    "KOD-POCZTOWY": "kod pocztowy",
    "DATA-UR": "datę urodzenia",
    "ADRES": "adres",
    "MIEJSCOWOSC": "miejscowość",
    "IMIE": "imię i nazwisko",
}

# The patterns below.
EMAIL = r"[A-Za-z0-9ąćęłńóśźżĄĆĘŁŃÓŚŹŻ._%+-]+@[A-Za-z0-9ąćęłńóśźżĄĆĘŁŃÓŚŹŻ.-]+\.[A-Za-z]{2,}"
JWT = r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}"
KEYS = r"\b(?:sk_(?:live|test)_[A-Za-z0-9]{8,}|(?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})"
MONTHS = "stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|października|listopada|grudnia"
DATE = rf"\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}"
FILLERS = rf"(?:\s+(?:to|o|nr|[A-Za-z{UP[3:]}{LO[3:]}]{{3,}})){{0,3}}"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    rf"(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|"
    rf"(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?:(?::{_H}){{1,6}})|:(?:(?::{_H}){{1,7}}|:)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d.])"
_SEP = r"[-‐-―](?:[ \t]*\r?\n[ \t   ]*)?"
KSEF = (
    rf"(?<![0-9A-Za-z])(?:\d{{10}}|[Mm]\d{{9}}){_SEP}20\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]){_SEP}"
    rf"(?:[0-9A-Fa-f]{{6}}{_SEP}[0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{12}}){_SEP}[0-9A-Fa-f]{{2}}(?![0-9A-Za-z])"
)
KSEF_ANCHOR = r"ksef|krajow\w*\s+system\w*\s+e[-‐-―]?faktur"
LEGAL_REFERENCE = r"(art\.?|§|ust\.?|pkt|poz\.?|sygn\.?|nr\s|dz\.?\s?u|regon|lp\.?|porządkow\w+|rejestr\w*|seryjn\w+|wersj\w+)\s*$"
NIP = r"(?:\d{3}[- ]\d{3}[- ]\d{2}[- ]\d{2}|\d{3}[- ]\d{2}[- ]\d{2}[- ]\d{3}|\d{10})"
NRB = r"(?:\d[ ]?){25}\d"
IBAN_SHAPE = r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}"
PLATE = r"(?!BMW\b)[A-Z]{2,3}[\s-]?\d[A-Z0-9]{3,4}"
PHONE_DIGITS = r"(?:\+?48[\s.-]{1,3})?(?:[\s\-().]{0,3}\d){9}"
PHONE_JOIN = r"\s*(?:,|\boraz\b|\bi\b)\s*"
CASE_MARK = rf"[{UP}]{{2,}}[0-9]*(?:-[A-Za-z{UP}{LO}0-9]+)*(?:\.[A-Za-z{UP}{LO}0-9-]+)*?\.\d+\.(?:19|20)\d{{2}}(?:\.[{UP}]{{2,3}})?"
CASE_VALUE = (
    rf"(?:[IVXLCDM]{{1,4}}[ \t]+)?[{UP}][A-Za-z{LO}]{{0,4}}(?:/[{UP}][A-Za-z{LO}]{{0,3}})?[ \t]+\d+[ \t]*/[ \t]*\d{{2,4}}"
    rf"|[A-Za-z0-9{UP}{LO}]+(?:[.\-/][A-Za-z0-9{UP}{LO}]+)+"
)
RANKS = "gen|płk|ppłk|mjr|kpt|por|ks|św|bp|abp|kard|marsz|prof|dr|inż|hr"
STREET = (
    r"[Uu][lLI1]\.|[Uu][Ll][Ii][Cc][AaIiYy]|[Aa][Ll]\.|[Aa][Ll][Ee][IiJj][AaIiĘę]?|[Oo][Ss]\.|[Oo][Ss][Ii][Ee][Dd][Ll][EeAaUu]|[Pp][Ll]\.|[Pp][Ll][Aa][Cc][UuAa]?|"
    rf"[Rr]ond[{LO}]*|[Mm]ost[{LO}]*|[Ss]kwer[{LO}]*|[Bb]ulwar[{LO}]*"
)
URL = r"""\b(?:https?://|www\.)[^\s<>"'„”()]+"""
URL_PARAMETERS = (
    ("LOGIN", r"([?&#](?:user(?:name|id)?|login|usr|uid)=)([^&#\s\[\]]+)"),
    ("EMAIL", r"([?&#](?:e-?mail|mail)=)([^&#\s\[\]]+)"),
    ("IMIE", r"([?&#](?:full_?name|first_?name|last_?name|name|imie|nazwisko|osoba)=)([^&#\s\[\]]+)"),
    ("TELEFON", r"([?&#](?:phone|tel(?:efon)?|mobile|msisdn)=)([^&#\s\[\]]+)"),
    ("PESEL", r"([?&#]pesel=)(\d+)"),
    ("KARTA", r"([?&#](?:card(?:number|no)?|karta|nr_?karty|numer_?karty)=)([^&#\s\[\]]+)"),
    ("TOKEN", r"([?&#](?:token|api_?key|secret|auth|access_?token)=)([^&#\s\[\]]+)"),
    ("KSEF", r"([?&#](?:ksef(?:_?number)?|nr_?ksef|numer_?ksef)=)([^&#\s\[\]]+)"),
)
FORM_FIELDS = (
    (r"^imię\s+i\s+nazwisko$|^nazwisko\s+i\s+imię$", "IMIE", "name"),
    (r"^nazwisk[ao](?:\s+(?:rodowe|panieńskie|poprzednie))?(?:\s+(?:matki|ojca))?$", "IMIE", "name"),
    (r"^(?:pierwsze\s+|drugie\s+|kolejne\s+)?imi(?:ę|ona)(?:\s+(?:ojca|matki))?$", "IMIE", "name"),
    (r"^data\s+urodzenia$", "DATA-UR", "date"),
    (r"^miejsce\s+urodzenia$", "MIEJSCOWOSC", "place"),
    (r"^miejscowość$", "MIEJSCOWOSC", "place"),
    (r"^(?:miejsce|adres)\s+(?:zamieszkania|zameldowania|pobytu)$", "MIEJSCOWOSC", "place"),
    (r"^ulica$", "ADRES", "addr"),
    (r"^(?:nr|numer)\s+(?:domu|lokalu|mieszkania)$", "ADRES", "addr"),
)
# Keys of XML and JSON fields, and the kinds they stand for.
STRUCT_KEYS = {
    "first": "imie imię imiona firstname givenname middlename",
    "surname": "nazwisko surname lastname familyname",
    "fullname": "fullname imienazwisko imięnazwisko osoba person",
    "name": "name",
    "phone": "phone phonenumber mobile tel telefon telephone fax",
    "email": "email mail",
    "addr": "street address addressline ulica adres",
    "city": "city town miasto miejscowosc miejscowość",
    "postal": "postalcode postcode zipcode zip kodpocztowy",
    "birth": "birthdate dateofbirth dob dataurodzenia",
    "login": "login username user userid",
    "pesel": "pesel",
    "nip": "nip",
    "regon": "regon",
}
STRUCT_TYPES = {
    "first": "IMIE", "surname": "IMIE", "fullname": "IMIE", "name": "IMIE", "phone": "TELEFON", "email": "EMAIL", "addr": "ADRES",
    "city": "MIEJSCOWOSC", "postal": "KOD-POCZTOWY", "birth": "DATA-UR", "login": "LOGIN", "pesel": "PESEL", "nip": "NIP", "regon": "REGON",
}
KIND_OF_KEY = {key: kind for kind, keys in STRUCT_KEYS.items() for key in keys.split()}


def struct_key(key: str) -> str:
    return key.lower().translate({ord(c): None for c in "._-"})


@dataclass(frozen=True)
class Rule:
    """``keep`` is what a match becomes: digits name groups that stay, * is the mask, all else stands for itself."""

    type: str
    pattern: str
    keep: str = "*"
    ignore_case: bool = False
    allow: Callable | None = None  # (match, text) -> bool
    not_after_reference: bool = False
    beside: Callable | None = None  # (match, text) -> bool: what Polish words before a match leave of it
    needs: Callable | None = None  # (raw text) -> bool, once for each text
    chain: int = 0  # digits that every match has with at most three other signs between
    mixed: bool = False  # every match has a capital beside a digit
    hint: str | None = None  # a quick pattern that every match holds
    always: bool = False  # tried on every text: patterns made while a text is read

    @property
    def regex(self):
        return rx(self.pattern, self.ignore_case)

    @cached_property
    def need(self) -> Need | None:
        return None if self.always else need(self.pattern, self.chain, self.mixed, self.hint)


def after_reference(text: str, at: int) -> bool:
    return bool(rx(LEGAL_REFERENCE, True).search(text[max(0, at - 24) : at]))


def _no_version(m, text: str) -> bool:
    return not rx(r"(?:wersj\w*|\bver\.?|\bv\.?)\s*$").search(text[max(0, m.start() - 12) : m.start()].lower())


def _vin(m, text: str) -> bool:
    found = m.group()
    return sum(c.isdigit() for c in found) >= 4 and sum("A" <= c <= "Z" for c in found) >= 3


def ksef_named(raw: str) -> bool:
    return bool(rx(KSEF_ANCHOR, True).search(raw))


def is_ksef(m, text: str = "") -> bool:
    whole = m.group()
    head = rx(r"[Mm]?\d+").match(whole).group()
    if not rx("[A-Fa-f]").search(whole[len(head) :]):
        return False
    return not head.isdigit() or (not head.startswith("0") and check.is_nip(head))


def _dowod(m, text: str) -> bool:
    return m.group(1) not in CURRENCIES and check.is_dowod(m.group())


IDENTITY = (
    Rule("EMAIL", EMAIL),
    Rule("TOKEN", rf"\b{JWT}"),
    Rule("TOKEN", KEYS, hint="sk_|gh[posur]_|github_pat_|xox[baprs]-"),
    Rule("MAC", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", hint="[:-][0-9A-Fa-f]{2}[:-]"),
    Rule("MAC", r"\b(?=[0-9A-Fa-f.]*[A-Fa-f])(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}(?![:\w-]|\.\w)", hint=r"\.[0-9A-Fa-f]{4}\."),
    Rule("MAC", r"\b((?:adres\w*\s+)?MAC[\s:.=-]+)((?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4})(?![:\w-]|\.\w)", "1*", True),
    Rule("IP", rf"(?<![:.\w])(?:{IPV6})(?![:\w]|\.\w)", hint=":(?::|(?:[0-9A-Fa-f]{1,4}:){6})"),
    Rule("IP", IPV4, beside=_no_version, not_after_reference=True, hint=r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
    Rule("VIN", r"\b((?:vin|nr\s+vin|numer\s+vin|nr\s+nadwozia|numer\s+nadwozia)[\s:.=-]*)([A-HJ-NPR-Za-hj-npr-z0-9]{17})\b", "1*", True),
    Rule("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", allow=_vin, mixed=True),
)
REFERENCES = (
    Rule("KSEF", KSEF, allow=is_ksef, needs=ksef_named),
    Rule("ZNAK-SPRAWY", rf"(?<![A-Za-z0-9./-]){CASE_MARK}(?!\d)"),
    Rule("ZNAK-SPRAWY", rf"\b(znak sprawy|znak pisma|nasz znak|wasz znak|sygn\.?[ \t]*akt|sygnatura akt|sygn\.|znak(?=[ \t]*:))([ \t]*:?[ \t]*)({CASE_VALUE})", "12*", True),
)
NUMBERS_1 = (
    Rule("IBAN", rf"\b{IBAN_SHAPE}\b", allow=lambda m, t: check.is_iban(m.group()), mixed=True),
    Rule("NR-KONTA", rf"\b(konto|konta|rachunek|rachunku|rachunek bankowy|nr konta|numer konta|iban)\b([\s:.-]*)({NRB})(?![ ]?\d)", "12*", True),
    Rule("NR-KONTA", rf"\b((?:konto|Konto|KONTO|konta|Konta|rachunek|Rachunek|RACHUNEK|rachunku|Rachunku|nr konta|Nr konta|numer konta|Numer konta|iban|Iban|IBAN){FILLERS})([\s:=.-]+)({IBAN_SHAPE})(?![A-Za-z0-9])", "12*"),
    Rule("NR-KONTA", rf"(?<!\d[ ]?){NRB}(?![ ]?\d)", allow=lambda m, t: check.is_iban("PL" + m.group().replace(" ", "")), chain=26),
    Rule("PESEL", r"(?<![\dA-Za-z])\d{11}(?![\d])", allow=lambda m, t: check.is_pesel(m.group()), not_after_reference=True),
    Rule("PESEL", rf"\b(pesel{FILLERS})([\s:=.-]+)(\d{{11}})(?![\d])", "12*", True),
    Rule("NIP", rf"(?<![\d])(?:PL[- ]?)?{NIP}(?![\d])", allow=lambda m, t: check.is_nip(m.group()), not_after_reference=True, chain=10),
    Rule("NIP", rf"\b(nip{FILLERS})([\s:=.-]+)((?:PL[- ]?)?{NIP})(?![\d])", "12*", True),
    Rule(
        "KARTA",
        rf"""\b((?:kart[{LO}]*|card|visa|mastercard|maestro|amex|american\s+express|diners(?:\s+club)?|discover|jcb|płatnicz[{LO}]*|kredytow[{LO}]*|debetow[{LO}]*)(?:[ \t]+(?:nr|numer|no)\.?)?)([\s:="'()<>|.-]+)((?:\d[ -]?){{12,18}}\d)(?![\d])""",
        "12*",
        True,
        allow=lambda m, t: check.is_card(m.group(3)),
    ),
    Rule("REGON", r"(?<![\d])\d{14}(?![\d])", allow=lambda m, t: check.is_regon14(m.group())),
    Rule("REGON", rf"\b(regon{FILLERS})([\s:=.-]+)(\d{{14}}|\d{{9}})(?![\d])", "12*", True),
)
PHONE_LISTS = (
    rf"\b(te[li]\.?|telefon\w{{0,4}}|kom\.?|komórk[aiwy]|fax|faks|nr te[li]\.?|kontakt\w{{0,4}})((?:\s+(?:kontaktow\w+|stacjonarn\w+|służbow\w+|komórkow\w+|domow\w+|telefoniczn\w+|pod|numer\w*))*[\s:.=-]*)"
    rf"({PHONE_DIGITS}(?:{PHONE_JOIN}(?:(?:kontaktow\w+|stacjonarn\w+|służbow\w+|komórkow\w+|domow\w+|kom\.?|tel\.?)\s+)?{PHONE_DIGITS})*)(?!\.?\d)"
)
NUMBERS_2 = (
    Rule("TELEFON", r"(?<![\d])(?:\+|00)[\s]?48(?:[\s\-().]{0,3}\d){9}(?!\.?\d)", not_after_reference=True, chain=11),
    Rule(
        "TELEFON",
        r"(?<![\d.])(?:\(\d{2}\)[ \t]?\d{3}[ \t-]?\d{2}[ \t-]?\d{2}|\d{3}[\s-]?\d{3}[\s-]?\d{3})(?!\.?\d)(?![ \t]*(?:,\d{2})?[ \t]*(?:zł|PLN|EUR|USD|gr\b))",
        allow=lambda m, t: check.digits(m.group())[0] != 0,
        not_after_reference=True,
        chain=9,
    ),
    Rule("DOWOD", r"\b((?:dow[oó]d\w*|dow\.|legitymacj\w*|dokument\w*\s+tożsamości|seria i numer|nr dowodu)(?:\s+(?:osobist\w+|służbow\w+|nr|numer|seria|i))*[\s:.=-]*)([A-Za-z]{3}[\s-]?\d{6})(?!\d)", "1*", True),
    Rule("DOWOD", r"\b([A-Z]{3})[\s-]?\d{6}\b", allow=_dowod),
    Rule("DOWOD", r"\b[A-Za-z]{3}[\s-]?\d{6}\b", allow=lambda m, t: check.is_dowod(m.group())),
    Rule("PASZPORT", r"\b((?:paszport\w*|dokument\w*\s+podróży|nr\s+paszportu|numer\s+paszportu)(?:\s+(?:nr\.?|numer|seria|i))*)([\s:.=-]*)([A-Za-z]{2}[\s-]?\d{7})(?!\d)", "12*", True),
    Rule("KRS", r"\bKRS((?:\s+(?:pod\s+)?(?:nr\.?|numer(?:em)?))?[\s:.=-]*)(\d{10})(?!\d)", "KRS1*", True),
    Rule(
        "PRAWO-JAZDY",
        r"\b((?:(?:nr|numer)\s+)?praw(?:o|a|em|ie)\s+jazdy(?:\s+(?:nr\.?|numer(?:u|ze|em)?|seri[ai]|kat\.?|kategori[ai]|o|[ABCDEMT]{1,2}\d?))*[\s:=.-]*)((?=[A-Za-z0-9/-]*\d)[A-Za-z0-9]{4,15}(?:[/-][A-Za-z0-9]{1,6}){0,3})",
        "1*",
        True,
    ),
    Rule("NR-REJESTRACYJNY", r"\b((?:nr\s+rej\w*|numer\s+rej\w*|rejestracyjn\w*|tablic\w*)(?:\s+(?:nr\.?|numer|pojazdu|rej\w*))*[\s:=.-]*)((?=[A-Z0-9\s-]{0,5}\d)[A-Z]{2,3}[\s-]?[A-Z0-9]{4,5})\b", "1*", True),
    Rule(
        "NR-REJESTRACYJNY",
        rf"\b([Pp]ojazd\w*|[Ss]amoch[oó]d\w*|[Mm]otocykl\w*|[Mm]otorower\w*|[Cc]iągnik\w*|[Pp]rzyczep\w*|[Aa]uto|[Pp]arking\w*|[Zz]aparkowan\w*)((?:\s+(?:o|nr\.?|numerze|siodłow\w+|ciężarow\w+|osobow\w+|dostawcz\w+|specjaln\w+|wolnobieżn\w+))*(?:\s+(?:marki|typu)\s+[{UP}][\w-]*(?=[\s:=.-]))?(?:\s+[{LO}]{{1,15}}){{0,3}}[\s:=.-]*)({PLATE})\b",
        "12*",
        allow=lambda m, t: m.group(3)[0] in PLATE_LETTERS,
    ),
)
POSTAL = (Rule("KOD-POCZTOWY", r"(?<![\d-])\d{2}-\d{3}(?![\d-])", not_after_reference=True),)
DATES = (
    Rule(
        "DATA-UR",
        rf"\b(ur\.|urodzony|urodzona|urodzeni[ae]|data urodzenia)((?:\s+dnia)?[\s:.,-]*)(\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:[IVX]{{1,4}}|{MONTHS})\s+\d{{4}})",
        "12*",
        True,
    ),
)
_FLAT = r"(?:\s*(?:m\.?|lok\.?|/)\s*\d+[A-Za-z]?)?"
ADDRESSES = (
    Rule(
        "ADRES",
        rf"\b({STREET})\s+(?:(?:\d+|{RANKS})\.?\s+|[{UP}]\.\s+){{0,2}}[{UP}][{LO}{UP}01.-]*(?:[ \t]+[{UP}0-9][{LO}{UP}0-9.-]*){{0,3}}[ \t]+\d+[A-Za-z]?(?:\s*(?:/|m\.?|lok\.?)\s*\d+[A-Za-z]?)?",
        allow=lambda m, t: not (rx("^(?:rond|most|skwer|bulwar)", True).search(m.group(1)) and rx(r"[^0-9](?:19|20)\d{2}$").search(m.group())),
    ),
)


def untyped_address(postal_mask: str) -> Rule:
    return Rule("ADRES", rf"\b([{UP}][{LO}]+(?:\s+[{UP}][{LO}]+){{0,2}})\s+\d+[A-Za-z]?{_FLAT}(\s*,?\s*)({escaped(postal_mask)})", "*23", always=True)


def bare_postal(address_mask: str) -> Rule:
    return Rule("KOD-POCZTOWY", rf"({escaped(address_mask)}\s*,?\s*)(?<!\d)\d{{5}}(?!\d)(?=[ \t]+{CAP_PLACE})", "1*", always=True)


def escaped(text: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in text)


def escaped_column(text: Column) -> Column:
    """A text column as ``escaped`` has it."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")
