"""Check digits of identifiers, as Python predicates and as Spark columns.

Both forms follow one table of weights. The column forms stay within Spark's expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import rx

# Digits, weights and what a remainder of 10 becomes (None: no valid number has it).
WEIGHTED = {
    "pesel": (11, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3), 10, 0),
    "nip": (10, (6, 5, 7, 2, 3, 4, 5, 6, 7), 11, None),
    "regon9": (9, (8, 9, 2, 3, 4, 5, 6, 7), 11, 0),
    "regon14": (14, (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8), 11, 0),
}
DOWOD_WEIGHTS = (7, 3, 1, 9, 1, 7, 3, 1, 7)
# Ranges of the leading four digits of card numbers.
CARD_RANGES = (
    (2221, 2720), (3000, 3059), (3400, 3499), (3528, 3589), (3600, 3699), (3700, 3799), (3800, 3999),
    (4000, 4999), (5000, 5099), (5100, 5599), (5600, 6999),
)


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def weighted(kind: str, text: str) -> bool:
    length, weights, base, at_ten = WEIGHTED[kind]
    d = digits(text)
    if len(d) != length:
        return False
    rest = sum(a * b for a, b in zip(d, weights)) % base
    want = (10 - rest) % 10 if base == 10 else at_ten if rest == 10 else rest
    return want == d[-1]


def is_pesel(text: str) -> bool:
    return weighted("pesel", text)


def is_nip(text: str) -> bool:
    return weighted("nip", text)


def is_regon9(text: str) -> bool:
    return weighted("regon9", text)


def is_regon14(text: str) -> bool:
    return weighted("regon14", text)


def _bare(text: str) -> str:
    return rx(r"\s").sub("", text).upper()


def is_iban(text: str) -> bool:
    s = _bare(text)
    if not 15 <= len(s) <= 34 or not rx(r"[A-Z]{2}\d{2}[A-Z0-9]+").fullmatch(s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def is_dowod(text: str) -> bool:
    s = _bare(text)
    return bool(rx(r"[A-Z]{3}\d{6}").fullmatch(s)) and sum(int(c, 36) * w for c, w in zip(s, DOWOD_WEIGHTS)) % 10 == 0


def luhn(d: list[int]) -> bool:
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def has_card_prefix(d: list[int]) -> bool:
    lead = int("".join(map(str, d[:4])))
    return any(a <= lead <= b for a, b in CARD_RANGES)


def is_card(text: str) -> bool:
    d = digits(text)
    return 13 <= len(d) <= 19 and has_card_prefix(d) and luhn(d)


# Columns


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def weighted_column(kind: str, c: Column) -> Column:
    length, weights, base, at_ten = WEIGHTED[kind]
    d = _only_digits(c)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % base
    want = (10 - rest) % 10 if base == 10 else F.when(rest == 10, F.lit(at_ten).try_cast("int")).otherwise(rest)
    return F.coalesce(F.when(F.length(d) == length, want == F.substring(d, length, 1).try_cast("int")), F.lit(False))


def _bound(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is named."""
    return F.transform(F.array(value), then)[0]


def iban_column(c: Column) -> Column:
    def remainder(number):
        # 34 signs are at most 68 digits; the remainder follows nine digits at a time.
        rest = F.lit(0).cast("long")
        for i in range(0, 72, 9):
            rest = (rest * 10**9 + F.substring(number, i + 1, 9).try_cast("long")) % 97
        return rest

    def valid(s):
        number = F.concat(F.substring(s, F.lit(5), F.length(s) - 4), F.substring(s, 1, 4))
        for i, letter in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            number = F.replace(number, F.lit(letter), F.lit(str(10 + i)))
        shaped = F.length(s).between(15, 34) & s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+\z")
        return F.when(shaped, _bound(F.lpad(number, 72, "0"), remainder) == 1).otherwise(False)

    return F.coalesce(_bound(F.upper(F.regexp_replace(c, r"[\s\u00a0]", "")), valid), F.lit(False))


def dowod_column(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"[\s ]", ""))
    value = lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(s, i, 1)) - 1
    total = sum((value(i + 1) * w for i, w in enumerate(DOWOD_WEIGHTS)), F.lit(0))
    return F.coalesce(F.when(s.rlike(r"^[A-Z]{3}[0-9]{6}\z"), total % 10 == 0), F.lit(False))


def luhn_column(c: Column) -> Column:
    return F.call_function("luhn_check", _only_digits(c))


def card_column(c: Column) -> Column:
    d = _only_digits(c)
    lead = F.substring(d, 1, 4).try_cast("int")
    known = F.lit(False)
    for a, b in CARD_RANGES:
        known = known | lead.between(a, b)
    return F.coalesce(F.length(d).between(13, 19) & known & F.call_function("luhn_check", d), F.lit(False))
