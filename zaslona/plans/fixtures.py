"""Texts derived from keys: the same SQL makes the input in Spark and the expected result in the oracle.

Even keys get a right control digit, odd ones a wrong one.
"""

from __future__ import annotations

from ..functions.checksums import DOWOD_WEIGHTS, WEIGHTED


def _digit(x: str, i: int) -> str:
    return f"cast(substr({x}, {i}, 1) as bigint)"


def _sum(x: str, weights) -> str:
    return "(" + " + ".join(f"{_digit(x, i + 1)} * {w}" for i, w in enumerate(weights)) + ")"


def _keyed(columns: str, where: str = "", inner: str = "") -> str:
    return f"select o_orderkey, {columns} from (select o_orderkey, {inner} from orders) t {where}"


def _body(n: int, factor: int) -> str:
    """n digits from a key."""
    return f"lpad(cast((o_orderkey * {factor}) % {10 ** min(n, 12)} as varchar({n})), {n}, '0')"


def _weighted(kind: str, factor: int) -> str:
    n, weights, base, at_ten = WEIGHTED[kind]
    total = _sum("b", weights)
    check = f"((10 - {total} % 10) % 10)" if base == 10 else f"({total} % 11 % 10)"
    where = f"where {total} % 11 <> 10" if at_ten is None else ""
    return _keyed(f"b || cast(({check} + o_orderkey % 2) % 10 as varchar(1)) as value", where, f"{_body(n - 1, factor)} as b")


def _mod97(x: str, n: int) -> str:
    """The remainder of a string of n digits, nine digits at a time."""
    out = "0"
    for i in range(1, n + 1, 9):
        size = min(9, n + 1 - i)
        out = f"(({out} * {10**size} + cast(substr({x}, {i}, {size}) as bigint)) % 97)"
    return out


def _iban() -> str:
    check = f"(98 - {_mod97('c', 30)} + (o_orderkey % 2) * 7) % 97"
    inner = f"{_body(24, 7919)} as b, {_body(24, 7919)} || '252100' as c"
    return _keyed(f"lpad(cast({check} as varchar(2)), 2, '0') || b as value", f"where 98 - {_mod97('c', 30)} between 10 and 89", inner)


def _dowod() -> str:
    rest = f"({10 * 7 + 11 * 3 + 12 * 1} + {' + '.join(f'{_digit("b", i + 1)} * {w}' for i, w in enumerate(DOWOD_WEIGHTS[4:]))})"
    return _keyed(f"'ABC' || cast(({rest} + o_orderkey % 2) % 10 as varchar(1)) || b as value", "", f"{_body(5, 7919)} as b")


def _card() -> str:
    doubled = lambda d: f"(2 * {d} - case when {d} > 4 then 9 else 0 end)"
    total = " + ".join(doubled(_digit("b", i)) if i % 2 else _digit("b", i) for i in range(1, 16))
    return _keyed(f"b || cast(((10 - ({total}) % 10) % 10 + o_orderkey % 2) % 10 as varchar(1)) as value", "", f"'4' || {_body(14, 104729)} as b")


VALUES = {
    "pesel": _weighted("pesel", 7919),
    "nip": _weighted("nip", 7919),
    "regon9": _weighted("regon9", 3571),
    "regon14": _weighted("regon14", 7919),
    "nrb": _iban(),
    "dowod": _dowod(),
    "card": _card(),
}
#: Seven digits that no rule takes for anything.
PLAIN = f"select o_orderkey, {_body(7, 7919)} as value from orders"

# name: (values, kinds, text, expected, how many are found)
_V, _EVEN = "value", "o_orderkey % 2 = 0"


def _bare(mask: str, before: str, after: str, shown: str = _V) -> tuple[str, str, str]:
    return f"'{before}' || {shown} || '{after}'", f"'{before}' || case when {_EVEN} then '{mask}' else {shown} end || '{after}'", f"case when {_EVEN} then 1 else 0 end"


def _labelled(mask: str, before: str, after: str, shown: str = _V, out: str | None = None) -> tuple[str, str, str]:
    return f"'{before}' || {shown} || '{after}'", f"'{out if out is not None else before}{mask}{after}'", "1"


_HEX = "lpad(cast(o_orderkey % 100000 as varchar(5)), 5, '0')"
_PHONE = "'6' || substr(value, 1, 2) || ' ' || substr(value, 2, 3) || ' ' || substr(value, 5, 3)"
TEXTS = {
    "r_pesel_bare": ("pesel", ["PESEL"], *_bare("[PESEL]", "Numer ", " w aktach")),
    "r_pesel_label": ("pesel", ["PESEL"], *_labelled("[PESEL]", "PESEL: ", " w aktach")),
    "r_nip_bare": ("nip", ["NIP"], *_bare("[NIP]", "Firma ", " z Gdyni")),
    "r_nip_label": ("nip", ["NIP"], *_labelled("[NIP]", "NIP ", ".", "substr(value, 1, 3) || '-' || substr(value, 4, 3) || '-' || substr(value, 7, 2) || '-' || substr(value, 9, 2)")),
    "r_regon_bare": ("regon14", ["REGON"], *_bare("[REGON]", "Spis ", " i dalej")),
    "r_regon_label": ("regon9", ["REGON"], *_labelled("[REGON]", "REGON: ", ";")),
    "r_iban": ("nrb", ["IBAN"], *_bare("[NR-KONTA]", "Przelew PL".replace("PL", ""), " dziś", "'PL' || value")),
    "r_account_bare": ("nrb", ["NR-KONTA"], *_bare("[NR-KONTA]", "Wpłata ", " dziś")),
    "r_account_label": ("nrb", ["NR-KONTA"], *_labelled("[NR-KONTA]", "nr konta: ", " dziś")),
    "r_card_ctx": ("card", ["KARTA"], *_bare("[NR-KARTY]", "karta nr ", " ważna")),
    "r_idcard_bare": ("dowod", ["DOWOD"], *_bare("[NR-DOWODU]", "Okazano ", " w kasie")),
    "r_idcard_label": ("dowod", ["DOWOD"], *_labelled("[NR-DOWODU]", "dowód osobisty nr ", " w kasie")),
    "r_ksef": ("nip", ["KSEF"], f"'KSeF ' || value || '-20250826-' || {_HEX} || '0A1F629-AF koniec'", f"'KSeF ' || case when {_EVEN} and substr(value, 1, 1) <> '0' then '[NR-KSEF]' else value || '-20250826-' || {_HEX} || '0A1F629-AF' end || ' koniec'", f"case when {_EVEN} and substr(value, 1, 1) <> '0' then 1 else 0 end"),
    "r_krs": ("plain", ["KRS"], *_labelled("[KRS]", "krs nr 000", ", sąd", out="KRS nr ")),
    "r_passport": ("plain", ["PASZPORT"], *_labelled("[NR-PASZPORTU]", "paszport nr AB", " ważny", out="paszport nr ")),
    "r_driver": ("plain", ["PRAWO-JAZDY"], *_labelled("[PRAWO-JAZDY]", "prawo jazdy nr ", " ważne", "value || '/99'")),
    "r_plate": ("plain", ["NR-REJESTRACYJNY"], "'nr rej. WA ' || substr(value, 1, 5) || ', KR ' || substr(value, 3, 5)", "'nr rej. [NR-REJESTRACYJNY], [NR-REJESTRACYJNY]'", "2"),
    "r_vin": ("plain", ["VIN"], *_labelled("[VIN]", "VIN: WVWZZZ1JZX", " auto", out="VIN: ")),
    "r_phone_ctx": ("plain", ["TELEFON"], f"'tel. ' || {_PHONE} || ', ' || {_PHONE} || ' rano'", "'tel. [TELEFON], [TELEFON] rano'", "2"),
    "r_phone_prefix": ("plain", ["TELEFON"], f"'dzwoń +48 ' || {_PHONE} || ' rano'", "'dzwoń [TELEFON] rano'", "1"),
    "r_phone_reference": ("plain", ["TELEFON"], f"'poz. ' || {_PHONE} || ' rejestru'", f"'poz. ' || {_PHONE} || ' rejestru'", "0"),
    "r_postal": ("plain", ["KOD-POCZTOWY"], "'kod ' || substr(value, 1, 2) || '-' || substr(value, 3, 3) || ' dalej'", "'kod [KOD-POCZTOWY] dalej'", "1"),
    "r_mac": ("plain", ["MAC"], "'karta 00:1A:' || substr(value, 1, 2) || ':' || substr(value, 2, 2) || ':' || substr(value, 3, 2) || ':' || substr(value, 4, 2) || ' dom'", "'karta [MAC] dom'", "1"),
    "r_ipv6": ("plain", ["IP"], "'host 2001:db8::' || substr(value, 1, 4) || ' dom'", "'host [IP] dom'", "1"),
    "r_token": ("plain", ["TOKEN"], "'klucz sk_live_ab' || value || 'cd tajny'", "'klucz [TOKEN] tajny'", "1"),
    "r_birth": ("plain", ["DATA-UR"], "'ur. 12.03.19' || substr(value, 1, 2) || ' r.'", "'ur. [DATA-URODZENIA] r.'", "1"),
    "r_case_mark": ("plain", ["ZNAK-SPRAWY"], "'znak sprawy: AB.' || substr(value, 1, 3) || '.' || substr(value, 4, 2) || '.2024 dnia'", "'znak sprawy: [ZNAK-SPRAWY] dnia'", "1"),
    "r_address": ("plain", ["ADRES"], "'ul. Długa 1' || substr(value, 1, 2) || '/2, tam'", "'[ADRES], tam'", "1"),
    "r_city": ("plain", ["ADRES", "KOD-POCZTOWY", "MIEJSCOWOSC"], "'ul. Długa 1' || substr(value, 1, 2) || ', 00-' || substr(value, 1, 3) || ' Nowy Sącz i dalej'", "'[ADRES], [KOD-POCZTOWY] [MIEJSCOWOŚĆ] i dalej'", "3"),
    "r_form": ("plain", ["IMIE", "ADRES"], "'Nazwisko:' || chr(10) || 'KOWALSKI' || chr(10) || 'Numer domu: 1' || substr(value, 1, 2)", "'Nazwisko:' || chr(10) || '[IMIĘ I NAZWISKO]' || chr(10) || 'Numer domu: [ADRES]'", "2"),
    "r_xml": ("plain", ["TELEFON", "LOGIN"], "'<a><Phone>' || value || '</Phone><user>u' || value || '</user><x>' || value || '</x></a>'", "'<a><Phone>[TELEFON]</Phone><user>[LOGIN]</user><x>' || value || '</x></a>'", "2"),
    "r_json": ("pesel", ["PESEL", "IMIE"], "'{\"lastName\": \"Nowak\", \"pesel\": \"' || value || '\", \"n\": 1}'", "'{\"lastName\": \"[IMIĘ I NAZWISKO]\", \"pesel\": \"[PESEL]\", \"n\": 1}'", "2"),
    "r_login": ("plain", ["LOGIN"], "'Login: ab' || value || chr(10) || 'wszedł ab' || value || ' dziś'", "'Login: [LOGIN]' || chr(10) || 'wszedł [LOGIN] dziś'", "2"),
    "r_url_param": ("plain", ["LOGIN", "EMAIL"], "'https://x.pl/a?user=u' || value || '&email=a' || value || '@b.pl&k=1.'", "'https://x.pl/a?user=[LOGIN]&email=[EMAIL]&k=1.'", "2"),
    "r_types_none": ("pesel", [], "'PESEL: ' || value", "'PESEL: ' || value", "0"),
    "r_types_other": ("pesel", ["EMAIL"], "'PESEL: ' || value || ' a' || value || '@b.pl'", "'PESEL: ' || value || ' [EMAIL]'", "1"),
}
_FIRST, _LAST = ["Jan", "Anna", "Piotr", "Maria"], ["Kowalski", "Nowak", "Wiśniewski", "Zieliński", "Szymański"]


def _pick(words: list[str], key: str = "c_custkey") -> str:
    return "case " + " ".join(f"when {key} % {len(words)} = {i} then '{w}'" for i, w in enumerate(words)) + " end"


# name: (text, expected, how many, pseudonyms), over customers
PERSONS = {
    "r_person_pair": (f"'Umowę podpisał ' || {_pick(_FIRST)} || ' ' || {_pick(_LAST)} || ' w biurze.'", "'Umowę podpisał [IMIĘ I NAZWISKO] w biurze.'", "1", False),
    "r_person_title": (f"'Pismo od Pana ' || {_pick(_LAST)} || ' wpłynęło.'", "'Pismo od Pana [IMIĘ I NAZWISKO] wpłynęło.'", "1", False),
    "r_person_solo": (f"'wezwano, by {'x'} ' || {_pick(_LAST)} || ' zeznał'", f"'wezwano, by {'x'} [IMIĘ I NAZWISKO] zeznał'", "1", False),
    "r_person_lower": (f"'pisze ' || lower({_pick(_FIRST)}) || ' ' || {_pick(['kowalski', 'nowak', 'wójcik'])} || ' do nas'", "'pisze [IMIĘ I NAZWISKO] do nas'", "1", False),
    "r_person_street": (f"'przy rondo ' || {_pick(['Jana', 'Anny'])} || ' ' || {_pick(['Kowalskiego', 'Nowaka'])} || ' dziś'", f"'przy rondo ' || {_pick(['Jana', 'Anny'])} || ' ' || {_pick(['Kowalskiego', 'Nowaka'])} || ' dziś'", "0", False),
    "r_pseudonym": (f"'Strona: ' || {_pick(_FIRST)} || ' ' || {_pick(_LAST)} || ' oraz {'Ewa'} Malinowska. Pan ' || {_pick(_LAST)} || ' wniósł skargę.'", "'Strona: [OSOBA-A] oraz [OSOBA-B]. Pan [OSOBA-A] wniósł skargę.'", "3", True),
}
