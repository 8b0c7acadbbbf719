"""Texts for single rules: each query deals its texts out by key, and the expected results stand beside them.

A {k} is two digits of the key.
"""

from __future__ import annotations

# name: (kinds, [(text, expected, how many)])
CASES: dict[str, tuple[list[str], list[tuple[str, str, int]]]] = {
    "r_url_mail": (
        ["EMAIL"],
        [
            ('zob. https://x.pl/p/ala{k}%40firma.pl/opis. Dalej', 'zob. https://x.pl/p/[EMAIL]/opis. Dalej', 1),
            ('zob. https://x.pl/p/ala{k}@firma.pl, dalej', 'zob. https://x.pl/p/[EMAIL], dalej', 1),
        ],
    ),
    "r_url_jwt": (
        ["TOKEN"],
        [
            ('link https://x.pl/#eyJhbGciOiJI.eyJzdWIiOiI17.abc_-17 koniec', 'link https://x.pl/#[TOKEN] koniec', 1),
        ],
    ),
    "r_url_ksef": (
        ["KSEF"],
        [
            ('KSeF: https://x.pl/faktura/5253000004-20250826-0A1F629AF017-AF, dalej', 'KSeF: https://x.pl/faktura/[NR-KSEF], dalej', 1),
            ('plik https://x.pl/faktura/5253000004-20250826-0A1F629AF017-AF, dalej', 'plik https://x.pl/faktura/5253000004-20250826-0A1F629AF017-AF, dalej', 0),
        ],
    ),
    "r_token_kinds": (
        ["TOKEN"],
        [
            ('nagłówek eyJhbGciOiJI.eyJzdWIiOiI17.abc_-17 koniec', 'nagłówek [TOKEN] koniec', 1),
            ('klucz ghp_ABCDEFGHIJKLMNOPQRST17 koniec', 'klucz [TOKEN] koniec', 1),
            ('klucz github_pat_ABCDEFGHIJKLMNOPQRST17 koniec', 'klucz [TOKEN] koniec', 1),
            ('klucz xoxb-1234567890-17 koniec', 'klucz [TOKEN] koniec', 1),
            ('klucz ghp_ABCDEF17 koniec', 'klucz ghp_ABCDEF17 koniec', 0),
        ],
    ),
    "r_mac_kinds": (
        ["MAC"],
        [
            ('port 001a.2b3c.4d{k} dom', 'port [MAC] dom', 1),
            ('port 0011.2233.4417 dom', 'port 0011.2233.4417 dom', 0),
            ('MAC: 0011.2233.44{k} dom', 'MAC: [MAC] dom', 1),
            ('port 00-1A-2B-3C-4D-{k} dom', 'port [MAC] dom', 1),
        ],
    ),
    "r_ip_guards": (
        ["IP"],
        [
            ('wersja 1.2.3.{k} programu', 'wersja 1.2.3.{k} programu', 0),
            ('adres 10.0.0.{k}. Koniec', 'adres 10.0.0.{k}. Koniec', 0),
        ],
    ),
    "r_vin_bare": (
        ["VIN"],
        [
            ('auto WVWZZZ1JZXW000017 stoi', 'auto [VIN] stoi', 1),
            ('kod ABCDEFGHJKLMNPR17 stoi', 'kod ABCDEFGHJKLMNPR17 stoi', 0),
        ],
    ),
    "r_login_quoted": (
        ["LOGIN"],
        [
            ('Użytkownik "ala.0{k}" usunięty', 'Użytkownik "[LOGIN]" usunięty', 1),
        ],
    ),
    "r_case_mark_structural": (
        ["ZNAK-SPRAWY"],
        [
            ('pismo WO-II.6220.17.2024.AB z maja', 'pismo [ZNAK-SPRAWY] z maja', 1),
        ],
    ),
    "r_account_iban_label": (
        ["NR-KONTA"],
        [
            ('nr konta: PL00 1140 2004 0000 3002 0135 5017 dziś', 'nr konta: [NR-KONTA] dziś', 1),
            ('KOntO: PL00 1140 2004 0000 3002 0135 5017 dziś', 'KOntO: PL00 1140 2004 0000 3002 0135 5017 dziś', 0),
        ],
    ),
    "r_phone_fallback": (
        ["TELEFON"],
        [
            ('numer 601 234 0{k} czynny', 'numer [TELEFON] czynny', 1),
            ('numer (22) 622 33 {k} czynny', 'numer [TELEFON] czynny', 1),
            ('kwota 601 234 0{k} zł netto', 'kwota 601 234 0{k} zł netto', 0),
            ('kod 012 345 017 ok', 'kod 012 345 017 ok', 0),
        ],
    ),
    "r_idcard_mixed": (
        ["DOWOD"],
        [
            ('okazano aBA123454 w kasie', 'okazano [NR-DOWODU] w kasie', 1),
            ('okazano aBA123455 w kasie', 'okazano aBA123455 w kasie', 0),
        ],
    ),
    "r_plate_vehicle": (
        ["NR-REJESTRACYJNY"],
        [
            ('samochód marki Skoda WA 12317 stał', 'samochód marki Skoda [NR-REJESTRACYJNY] stał', 1),
            ('samochód BMW 12317 stał', 'samochód BMW 12317 stał', 0),
        ],
    ),
    "r_address_untyped": (
        ["ADRES", "KOD-POCZTOWY"],
        [
            ('mieszka: Leśna {k}, 00-950 Warszawa', 'mieszka: [ADRES], [KOD-POCZTOWY] Warszawa', 2),
        ],
    ),
    "r_address_kinds": (
        ["ADRES"],
        [
            ('rondo Bitwy Warszawskiej 1920 remont', 'rondo Bitwy Warszawskiej 1920 remont', 0),
            ('uI. Długa {k} m. 4 klatka', '[ADRES] klatka', 1),
        ],
    ),
    "r_postal_bare": (
        ["ADRES", "KOD-POCZTOWY"],
        [
            ('ul. Długa {k}, 00950 Warszawa', '[ADRES], [KOD-POCZTOWY] Warszawa', 2),
        ],
    ),
    "r_city_unit": (
        ["MIEJSCOWOSC"],
        [
            ('w rejestrze Nowy Sącz (miasto) jest {k}', 'w rejestrze [MIEJSCOWOŚĆ] (miasto) jest {k}', 1),
            ('w rejestrze Brzozów (gmina miejska) jest 17', 'w rejestrze [MIEJSCOWOŚĆ] (gmina miejska) jest 17', 1),
        ],
    ),
    "r_city_before_address": (
        ["ADRES", "MIEJSCOWOSC"],
        [
            ('Biuro Kraków, ul. Długa {k} czynne', 'Biuro [MIEJSCOWOŚĆ], [ADRES] czynne', 2),
        ],
    ),
    "r_city_after_address": (
        ["ADRES", "MIEJSCOWOSC"],
        [
            ('ul. Długa {k}, Kraków i dalej', '[ADRES], [MIEJSCOWOŚĆ] i dalej', 2),
            ('ul. Długa {k} w Krakowie, dalej', '[ADRES] w [MIEJSCOWOŚĆ], dalej', 2),
        ],
    ),
    "r_city_residence": (
        ["MIEJSCOWOSC"],
        [
            ('zam. w Krakowie, nr {k}', 'zam. w [MIEJSCOWOŚĆ], nr {k}', 1),
        ],
    ),
    "r_city_birth": (
        ["MIEJSCOWOSC", "DATA-UR"],
        [
            ('urodzony 12.03.1917 r. w Krakowie, syn', 'urodzony [DATA-URODZENIA] r. w [MIEJSCOWOŚĆ], syn', 2),
        ],
    ),
    "r_city_raw_postal": (
        ["MIEJSCOWOSC"],
        [
            ('kod 00-917 Kraków dalej', 'kod 00-917 [MIEJSCOWOŚĆ] dalej', 1),
        ],
    ),
    "r_person_couple": (
        ["IMIE"],
        [
            ('zeznali Jan i Anna Kowalscy wczoraj', 'zeznali [IMIĘ I NAZWISKO] i [IMIĘ I NAZWISKO] wczoraj', 1),
            ('zeznali Jan oraz Anna Nowak wczoraj', 'zeznali [IMIĘ I NAZWISKO] i [IMIĘ I NAZWISKO] wczoraj', 1),
        ],
    ),
    "r_person_by_ending": (
        ["IMIE"],
        [
            ('wniosek Zenobii Brzezickiej przyjęto', 'wniosek Zenobii [IMIĘ I NAZWISKO] przyjęto', 1),
            ('wniosek złożyła pani Zenobia Brzezicka wczoraj', 'wniosek złożyła pani [IMIĘ I NAZWISKO] wczoraj', 1),
            ('firma Wody Krakowskiej działa', 'firma Wody Krakowskiej działa', 0),
        ],
    ),
    "r_person_turned": (
        ["IMIE"],
        [
            ('lista: Kowalski Jan obecny', 'lista: [IMIĘ I NAZWISKO] obecny', 1),
            ('Do: Brzoza Jan\ntemat', 'Do: [IMIĘ I NAZWISKO]\ntemat', 1),
            ('lista: Brzoza Jan obecny', 'lista: Brzoza Jan obecny', 0),
        ],
    ),
    "r_person_maiden": (
        ["IMIE"],
        [
            ('świadek Anna z domu Zielińska zeznała', 'świadek [IMIĘ I NAZWISKO] zeznała', 1),
            ('świadek Anna z Nowaków zeznała', 'świadek [IMIĘ I NAZWISKO] zeznała', 1),
        ],
    ),
    "r_person_strong_trigger": (
        ["IMIE"],
        [
            ('NAZYWAM SIĘ jan kowalski i proszę', 'NAZYWAM SIĘ [IMIĘ I NAZWISKO] i proszę', 1),
        ],
    ),
    "r_person_initial": (
        ["IMIE"],
        [
            ('zdaniem J. Kowalskiego sprawa', 'zdaniem [IMIĘ I NAZWISKO] sprawa', 1),
            ('1\nJ. Kowalski sprawa', '1\nJ. [IMIĘ I NAZWISKO] sprawa', 1),
            ('zdaniem pana J. Wilka sprawa', 'zdaniem pana [IMIĘ I NAZWISKO] sprawa', 1),
        ],
    ),
    "r_person_foreign": (
        ["IMIE"],
        [
            ('gość Jean-Pierre van Dubois przybył', 'gość [IMIĘ I NAZWISKO] przybył', 1),
        ],
    ),
    "r_person_single": (
        ["IMIE"],
        [
            ('zdaniem Brzezickiego sprawa', 'zdaniem [IMIĘ I NAZWISKO] sprawa', 1),
            ('zdaniem Krakowskiego sprawa', 'zdaniem Krakowskiego sprawa', 0),
        ],
    ),
    "r_person_ocr_title": (
        ["IMIE"],
        [
            ('PAN KOWALSKI wniósł', 'PAN [IMIĘ I NAZWISKO] wniósł', 1),
        ],
    ),
    "r_person_ocr_pair": (
        ["IMIE"],
        [
            ('świadek JAN K0WALSKI wniósł', 'świadek [IMIĘ I NAZWISKO] wniósł', 1),
        ],
    ),
    "r_person_ocr_mix": (
        ["IMIE"],
        [
            ('świadek KowaIski wniósł', 'świadek [IMIĘ I NAZWISKO] wniósł', 1),
        ],
    ),
    "r_absorb_first_name": (
        ["IMIE"],
        [
            ('świadek Jan\nKowalski wniósł', 'świadek [IMIĘ I NAZWISKO] wniósł', 1),
        ],
    ),
    "r_absorb_initial": (
        ["IMIE"],
        [
            ('wniósł J. Kowalski-Nowak ok', 'wniósł [IMIĘ I NAZWISKO] ok', 1),
            ('wniósł J.[IMIĘ I NAZWISKO] ok', 'wniósł [IMIĘ I NAZWISKO] ok', 0),
        ],
    ),
    "r_absorb_particle": (
        ["IMIE"],
        [
            ('gość Jan Kowalski van Dijk wniósł', 'gość [IMIĘ I NAZWISKO] wniósł', 1),
        ],
    ),
    "r_guard_admin_label": (
        ["IMIE"],
        [
            ('powiat Kowalski i dalej', 'powiat Kowalski i dalej', 0),
        ],
    ),
    "r_guard_thing_before": (
        ["IMIE"],
        [
            ('choroba Kowalskiego i dalej', 'choroba Kowalskiego i dalej', 0),
        ],
    ),
    "r_guard_patron": (
        ["IMIE"],
        [
            ('szkoła im. Kowalskiego i dalej', 'szkoła im. Kowalskiego i dalej', 0),
        ],
    ),
    "r_guard_street_word": (
        ["IMIE"],
        [
            ('przy ulicy Jana Kowalskiego i dalej', 'przy ulicy Jana Kowalskiego i dalej', 0),
        ],
    ),
    "r_guard_capital_before": (
        ["IMIE"],
        [
            ('Wielki Brzezicki i dalej', '[IMIĘ I NAZWISKO] i dalej', 1),
        ],
    ),
    "r_person_sequence": (
        ["IMIE"],
        [
            ('przyszedł dyrektor Jan Maria Nowak Rokita wczoraj', 'przyszedł dyrektor [IMIĘ I NAZWISKO] Rokita wczoraj', 1),
            ('pisze anna maria nowak do nas', 'pisze anna [IMIĘ I NAZWISKO] do nas', 1),
        ],
    ),
}


def _literal(text: str) -> str:
    """SQL for a text with the key's digits."""
    key = "' || cast(c_custkey % 90 + 10 as varchar(2)) || '"
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{k}", key) + "'"


def dealt(values: list, quote=_literal) -> str:
    """SQL that deals values out by key."""
    return "case " + " ".join(f"when c_custkey % {len(values)} = {i} then {quote(v)}" for i, v in enumerate(values)) + " end"
