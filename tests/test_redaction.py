"""One hit and one miss for the rules, and the options."""

import pytest

from zaslona.operators.fold import redact_text
from zaslona.operators.redact import has_pii, labels_of, native, redact, spans
from pyspark.sql import functions as F

CASES = [
    ("mail a.żak@firma.pl dziś", "mail [EMAIL] dziś"),
    ("token eyJabcdef.ghijklm.nop i sk_live_abcdefgh", "token [TOKEN] i [TOKEN]"),
    ("karta 00:1A:2B:3C:4D:5E", "karta [MAC]"),
    ("MAC: 0012.3456.7890", "MAC: [MAC]"),
    ("host 10.0.0.1 działa", "host [IP] działa"),
    ("host 10.0.0.1.", "host 10.0.0.1."),
    ("wersja 10.0.0.1 działa", "wersja 10.0.0.1 działa"),
    ("adres 2001:db8::1 działa", "adres [IP] działa"),
    ("VIN: wvwzzz1jzxw000001 auto", "VIN: [VIN] auto"),
    ("1HGCM82633A004352", "[VIN]"),
    ("PESEL 44051401359", "PESEL [PESEL]"),
    ("liczba 44051401358 sztuk", "liczba 44051401358 sztuk"),
    ("art. 44051401359 kodeksu", "art. 44051401359 kodeksu"),
    ("NIP: 526-10-40-828", "NIP: [NIP]"),
    ("REGON 12345678", "REGON 12345678"),
    ("regon: 123456789", "regon: [REGON]"),
    ("konto 61 1090 1014 0000 0712 1981 2874", "konto [NR-KONTA]"),
    ("karta 4111 1111 1111 1111", "karta [NR-KARTY]"),
    ("zamówienie 4111111111111111", "zamówienie 4111111111111111"),
    ("tel. 600 700 800, 601-701-801 oraz 602 702 802", "tel. [TELEFON], [TELEFON] oraz [TELEFON]"),
    ("kwota 600 700 800 zł", "kwota 600 700 800 zł"),
    ("dowód ABC123456", "dowód [NR-DOWODU]"),
    ("PLN 123456 do zapłaty", "PLN 123456 do zapłaty"),
    ("paszport AB1234567", "paszport [NR-PASZPORTU]"),
    ("krs 0000123456", "KRS [KRS]"),
    ("prawo jazdy nr 12345/06/1234", "prawo jazdy nr [PRAWO-JAZDY]"),
    ("nr rej. WA 12345, KR 5678A i GD 9ABC1", "nr rej. [NR-REJESTRACYJNY], [NR-REJESTRACYJNY] i [NR-REJESTRACYJNY]"),
    ("ksef 5265877635-20250826-0100001AF629-AF", "ksef [NR-KSEF]"),
    ("faktura 5265877635-20250826-0100001AF629-AF", "faktura [NIP]-20250826-0100001AF629-AF"),
    ("znak sprawy: OR.123.4.2024", "znak sprawy: [ZNAK-SPRAWY]"),
    ("Login: jkowal\nwszedł jkowal", "Login: [LOGIN]\nwszedł [LOGIN]"),
    ("Nazwisko:\nKOWALSKI\nImię: pamela", "Nazwisko:\n[IMIĘ I NAZWISKO]\nImię: [IMIĘ I NAZWISKO]"),
    ("Nazwisko:\nRozpoznanie: x", "Nazwisko:\nRozpoznanie: x"),
    ("Data urodzenia\n12.03.1980 r.", "Data urodzenia\n[DATA-URODZENIA] r."),
    ("<Surname>Nowak</Surname><x>Stół</x>", "<Surname>[IMIĘ I NAZWISKO]</Surname><x>Stół</x>"),
    ('{"city": "Gdynia", "nip": "5261040828"}', '{"city": "[MIEJSCOWOŚĆ]", "nip": "[NIP]"}'),
    ("ul. gen. Andersa 5 m. 2, 00-950 Nowy Sącz", "[ADRES], [KOD-POCZTOWY] [MIEJSCOWOŚĆ]"),
    ("rondo Kowalskiego 1999", "rondo Kowalskiego 1999"),
    ("zam. w Krakowie, ur. 12.03.1980 w Gdyni", "zam. w [MIEJSCOWOŚĆ], ur. [DATA-URODZENIA] w [MIEJSCOWOŚĆ]"),
    ("mieszkał w Nieznanowie", "mieszkał w Nieznanowie"),
    ("Umowę podpisał Jan Kowalski wczoraj", "Umowę podpisał [IMIĘ I NAZWISKO] wczoraj"),
    ("Prezes Gzowski podpisał", "Prezes [IMIĘ I NAZWISKO] podpisał"),
    ("przy rondo Jana Kowalskiego dziś", "przy rondo Jana Kowalskiego dziś"),
    ("Od: Kowalski Jan", "Od: [IMIĘ I NAZWISKO]"),
    ("pisze jan kowalski do nas", "pisze [IMIĘ I NAZWISKO] do nas"),
    ("Maria z domu Nowak", "[IMIĘ I NAZWISKO]"),
    ("Nazywam się pamela", "Nazywam się [IMIĘ I NAZWISKO]"),
    ("choroba Kowalskiego postępuje", "choroba Kowalskiego postępuje"),
    ("Powiat: Pruszkowski", "Powiat: Pruszkowski"),
    ("Spotkał J. Nowak z nami", "Spotkał [IMIĘ I NAZWISKO] z nami"),
    ("Pan Jean-Pierre Dubois", "Pan [IMIĘ I NAZWISKO]"),
    ("SĘDZIA KOWALSKI orzekł", "SĘDZIA [IMIĘ I NAZWISKO] orzekł"),
    ("SĄD NAJWYŻSZY orzekł", "SĄD NAJWYŻSZY orzekł"),
    ("zeznał JAN K0WALSKI dziś", "zeznał [IMIĘ I NAZWISKO] dziś"),
    ("https://x.pl/a?user=abc&pesel=123#token=z.", "https://x.pl/a?user=[LOGIN]&pesel=[PESEL]#token=[TOKEN]."),
    ("https://x.pl/jan-kowalski", "https://x.pl/jan-kowalski"),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_rules(text, expected):
    assert redact_text(text)[0] == expected


@pytest.mark.parametrize("text", [c[0] for c in CASES])
@pytest.mark.parametrize("pseudonyms", [False, True])
def test_twice_is_once(text, pseudonyms):
    once = redact_text(text, pseudonyms=pseudonyms)[0]
    assert redact_text(once, pseudonyms=pseudonyms)[0] == once


def test_pseudonyms_follow_the_person_and_the_place():
    text = "Strona: Jan Kowalski oraz Ewa Malinowska. Pan Kowalski wniósł skargę."
    assert redact_text(text, pseudonyms=True)[0] == "Strona: [OSOBA-A] oraz [OSOBA-B]. Pan [OSOBA-A] wniósł skargę."
    assert redact_text("Anna i Piotr Wiśniewscy", pseudonyms=True)[0] == "[OSOBA-A] i [OSOBA-A]"


def test_options():
    assert redact_text("PESEL 44051401359", types=[]) == ("PESEL 44051401359", [])
    assert redact_text("PESEL 44051401359 a@b.pl", types=["EMAIL"]) == ("PESEL 44051401359 [EMAIL]", [("EMAIL", 1)])
    assert redact_text("PESEL 44051401359", masks={"PESEL": "<x>"})[0] == "PESEL <x>"
    assert redact_text("00-950 i a@b.pl i c@d.pl")[1] == [("EMAIL", 2), ("KOD-POCZTOWY", 1)]
    assert redact_text(None) == ("", []) and redact_text("") == ("", [])


def test_columns(spark):
    df = spark.createDataFrame([(1, "a@b.pl", "x"), (2, None, "y"), (3, "", "z"), (1, "a@b.pl", "x")], "doc_id long, text string, found string")
    rows = redact(df).orderBy("doc_id").collect()
    assert [r["redacted"] for r in rows] == ["[EMAIL]", "[EMAIL]", "", ""] and rows[2]["found"] == []
    assert redact(df.limit(0)).count() == 0
    assert has_pii(df.select("doc_id", "text")).count() == 2
    assert redact(df).select(labels_of(F.col("found")).alias("l")).where("size(l) > 0").first()["l"] == ["adres e-mail"]
    with pytest.raises(ValueError):
        redact(df, types=["NO"])
    text, n = native(F.col("text"), "EMAIL")
    assert df.where("doc_id = 1").select(text.alias("t"), n.alias("n")).first() == ("[EMAIL]", 1)
    assert [tuple(r) for r in spans(df.where("doc_id = 1").limit(1)).collect()] == [(1, 0, "[EMAIL]", "a@b.pl", 0, 6)]


def test_one_python_step(spark):
    plan = redact(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_addresses_count_after_words_of_other_languages(spark, tmp_path):
    from zaslona.plans import catalog

    text = "zu ver 42.244.84.203 und ereraust 74.123.97.42 von v. 1.2.3.4"
    assert redact_text(text, types=["IP"]) == (text, [])
    assert redact_text(text, types=["IP"], guarded=False) == ("zu ver [IP] und ereraust [IP] von v. [IP]", [("IP", 3)])
    assert redact_text("PESEL nr 44051401359, art. 44051401358", guarded=False)[0] == "PESEL nr [PESEL], art. 44051401358"
    spark.createDataFrame([(1, text, "de", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["r_ipv4"](spark, str(tmp_path)).collect()] == [(1, 3)]
    assert [tuple(r) for r in catalog.QUERIES["f_by_type"](spark, str(tmp_path)).collect()] == [("IP", 3, 1)]
    assert [tuple(r) for r in catalog.QUERIES["x_tokens_dim"](spark, str(tmp_path)).collect()] == [("[IP]", "IP", "adres IP", 3)]


def _of_repeated(spark, tmp_path, name):
    from zaslona.plans import catalog

    rows = [(1, "b@c.pl i d@e.pl"), (1, "10.0.0.1 a@b.pl"), (1, "a@b.pl"), (2, "10.0.0.1"), (3, None), (3, "nic"), (4, "już [EMAIL], [PESEL] oraz x@y.pl")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))


def test_documents_given_twice_count_once(spark, tmp_path):
    expected = {
        "f_has_pii": [(1,), (2,), (4,)],
        "f_describe": [(1, "adres e-mail,adres IP"), (2, "adres IP"), (4, "adres e-mail")],
        "f_merge": [(1, 9), (2, 1), (4, 2)],
        "f_summary": [(7, 2, 3)],
    }
    for name, rows in expected.items():
        assert _of_repeated(spark, tmp_path / name, name) == rows


def test_masks_that_texts_hold_already_are_not_counted(spark, tmp_path):
    assert _of_repeated(spark, tmp_path / "m", "x_mask_tokens") == [("[EMAIL]", 5), ("[IP]", 2)]
    assert [r[0] for r in _of_repeated(spark, tmp_path / "d", "x_tokens_dim")] == ["[EMAIL]", "[IP]"]


def test_findings_of_odd_texts_equal_the_sql(spark, tmp_path):
    """Links, %40, IPv6, numbers before an @, fields and addresses that follow each other, against DuckDB."""
    import random

    import duckdb

    from zaslona.plans import catalog

    rng = random.Random(5)
    parts = ["10.0.0.1", "a@b.pl", "@", ".", "https://", "www.", "/x?mail=", "%40", "::1", " ", "\n", "_", "ż", "256.1.1.1", "1.2.3.4.5", "007.1.2.3", "<a>", "</a>", '"email": "', '"', "c.de", "(at)", "v. ", "٣", "[EMAIL]", "-", "I", "x"]
    texts = ["http://10.0.0.1/a@b.pl", "a%40b.pl", "10.0.0.1@b.pl", "fe80::1.2.3.4", "a@b.pl_c@d.pl@e.pl", "a" * 200_000 + " a@b.pl", None, ""]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(1500)]
    rows = [(None if i % 97 == 0 else i % 700, t, rng.choice(["pl", "de", None]), rng.choice(["s", "t", None])) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("f_has_pii", "f_merge", "f_describe", "f_summary", "f_by_type", "f_by_lang_rollup", "f_cube", "f_top_sources"):
        expected = sorted(con.execute(catalog.SQL[name]).fetchall(), key=str)
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == expected and expected, name


def test_a_repeated_text_is_folded_once_a_batch(monkeypatch):
    import pandas as pd

    from zaslona.operators import redact as module

    folded = []

    def noting(text, *rest):
        folded.append(text)
        return redact_text(text, *rest)

    monkeypatch.setattr(module, "redact_text", noting)
    texts = ["Nazwisko:\nKOWALSKI", "a@b.pl i c@d.pl", None, "", "a@b.pl i c@d.pl", "nic", "Nazwisko:\nKOWALSKI", None] * 50
    out = module.redaction(pseudonyms=True).func(pd.Series(texts, dtype=object))
    expected = [redact_text(t, pseudonyms=True) for t in texts]
    assert list(out["redacted"]) == [r[0] for r in expected]
    assert [[(f["type"], f["count"]) for f in found] for found in out["found"]] == [r[1] for r in expected]
    assert len(folded) == 5


@pytest.mark.parametrize("pseudonyms", [False, True])
def test_texts_made_equal_by_a_mask_go_on_once(monkeypatch, pseudonyms):
    """A batch of forms in which only masked numbers differ is searched for persons a few times, not once for each."""
    import pandas as pd

    from zaslona.operators import fold
    from zaslona.operators import redact as module

    texts = [f"PESEL: {44051401359 + k}, Jan Kowalski, ul. Długa 5, 00-950 Warszawa, tel. 600 700 {k % 7}00" for k in range(300)]
    expected = [redact_text(t, pseudonyms=pseudonyms) for t in texts]
    runs, plain = [], fold.Persons

    def noting(state):
        runs.append(state)
        return plain(state)

    monkeypatch.setattr(fold, "Persons", noting)
    out = module.redaction(pseudonyms=pseudonyms).func(pd.Series(texts, dtype=object))
    assert [(a, [(f["type"], f["count"]) for f in b]) for a, b in zip(out["redacted"], out["found"])] == expected
    assert len(runs) <= 10


def test_texts_that_meet_keep_their_own_counts_labels_and_links():
    texts = [
        "a@b.pl 44051401359 Jan Nowak", "[EMAIL] 44051401359 Jan Nowak", "[EMAIL] [PESEL] Jan Nowak", "a@b.pl [PESEL] Jan Nowak",
        "00-950 a@b.pl 44051401359", "[KOD-POCZTOWY] [EMAIL] 44051401359",
        "<surname>Nowak</surname> 44051401359 Jan Nowak", "<surname>Wilk</surname> 44051401359 Jan Nowak", "<surname>[OSOBA-A]</surname> 44051401359 Jan Nowak",
        "KSeF 1234563218-20250826-0A1F62900A1F-AF 44051401359", "1234563218-20250826-0A1F62900A1F-AF 44051401359", "ksef 44051401359",
        "https://x.pl/?user=a1 44051401359", "https://x.pl/?user=a2 44051401359", "https://y.pl/ 44051401359",
    ]
    for options in ({}, {"pseudonyms": True}, {"types": ["PESEL", "IMIE"]}, {"types": ["KSEF", "PESEL"]}):
        onward = {}
        assert [redact_text(t, **options, onward=onward) for t in texts * 2] == [redact_text(t, **options) for t in texts * 2]
        assert onward


def test_names_are_looked_up_once_a_batch(monkeypatch):
    import pandas as pd

    from zaslona.operators import redact as module

    asked, plain = [], module._names
    monkeypatch.setattr(module, "_names", lambda lexicon: asked.append(lexicon) or plain(lexicon))
    texts = pd.Series([f"Jan Nowak {k}" for k in range(50)], dtype=object)
    module.redaction().func(texts)
    module.places().func(texts)
    assert len(asked) == 2
