"""The prefilter leaves out no rule that matches, places are exact, and tables of forms agree with readings."""

import random

import pytest
from pyspark.errors import PySparkException
from test_redaction import CASES

from zaslona.functions.lexicon import DEFAULT
from zaslona.functions.morphology import KNOWN_STEM, Names, forms, name_forms, readings
from zaslona.operators import fold, persons, prefilter
from zaslona.operators import rules as R
from zaslona.operators.ledger import Ledger, Stretch, rewritten
from zaslona.operators.redact import register, spans
from zaslona.plans.cases import CASES as SINGLE

NUMBERS = ["REGON 12345678512347", "konto DE89370400440532013000", "61109010140000071219812874", "ABS123456 i ABS 523456", "ABA300000", "aba300000", "+48 601 234 567", "0048601234567", "AA:BB:CC:DD:EE:FF", "dowód xx ABC123456"]
TEXTS = [c[0] for c in CASES] + NUMBERS + [r[0].replace("{k}", "17") for _, rows in SINGLE.values() for r in rows]


def mixed_texts(seed, n):
    """Texts put together of others and of their words, some with signs changed."""
    rng = random.Random(seed)
    words = sorted({w for t in TEXTS for w in t.split()})
    for _ in range(n):
        if rng.random() < 0.4:
            t = rng.choice([" ", "\n", ", "]).join(rng.sample(TEXTS, rng.randrange(1, 5)))
        else:
            t = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\n", ", ", ". ", "\t", "  ", "-", " i "]) for _ in range(rng.randrange(2, 14)))
        if rng.random() < 0.3:
            signs = list(t)
            for _ in range(3):
                signs[rng.randrange(len(signs))] = rng.choice("Aa1-I0 ł.ZſK")
            t = "".join(signs)
        yield t


@pytest.mark.parametrize("pattern,strings,digits", [
    ("[Uu][lL]\\.[ ]+(?:abc|dexf)", {"abc", "dexf"}, 0),
    (r"\b(tel|fax)\d{3}\d", {"tel", "fax"}, 4),
    (r"(?:\d{3}-)?\d{2}", None, 2),
    (r"x?y*z", {"z", "xz"}, 0),
    (r"(?<!q)mail(?=\d{9})", {"mail"}, 0),
    (r"[\p{L}]+(?:\d{7}|[A-F]{2}\d{5})", None, 5),
    (r"a|b*", None, 0),
])
def test_what_a_pattern_holds(pattern, strings, digits):
    found = prefilter.held(pattern)
    assert prefilter._best(found.exact, found.one_of) == strings or (strings == {"z", "xz"} and "z" in prefilter._best(found.exact, found.one_of))
    assert found.digits == digits


def test_needs_are_met_by_every_match():
    known = persons.tags_of(fold._names(DEFAULT)).known
    tags = persons.tags_of(fold._names(DEFAULT))
    table = [r for rules in (R.IDENTITY, R.REFERENCES, R.NUMBERS_1, R.NUMBERS_2, R.POSTAL, R.DATES, R.ADDRESSES) for r in rules]
    hit = set()
    for text in [*TEXTS, *mixed_texts(1, 1500)]:
        facts = prefilter.Facts(text, known)
        for i, rule in enumerate(table):
            if any(not rule.allow or rule.allow(m, text) for m in rule.regex.finditer(text)):
                hit.add(i)
                assert rule.need.met(facts), (rule, text)
        for rule in persons.PERSONS:
            if any(rule.edits(m, text, tags, str) for m in persons.rx(rule.shape, rule.ignore_case).finditer(text)):
                hit.add(rule)
                assert rule.need.met(facts), (rule.shape, text)
    assert [r for i, r in enumerate(table) if i not in hit] + [r for r in persons.PERSONS if r not in hit] == []


@pytest.mark.parametrize("seed", [2, 3])
def test_results_without_the_prefilter_are_the_same(monkeypatch, seed):
    texts = [*TEXTS, *mixed_texts(seed, 1200)]
    filtered = [fold.redact_text(t, pseudonyms=i % 3 == 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(prefilter.Need, "met", lambda self, facts: True)
    assert [fold.redact_text(t, pseudonyms=i % 3 == 0) for i, t in enumerate(texts)] == filtered


def test_strings_that_become_known_later():
    known = persons.tags_of(fold._names(DEFAULT)).known
    facts = prefilter.Facts("zzqqa zzqqb", known)
    assert not prefilter.need("zzqqc").met(facts)
    assert prefilter.need("zzqqb").met(facts) and prefilter.need("[Zz]zqqa").met(facts) and not prefilter.need("zzqqd").met(facts)


def test_needs_are_worked_out_once_for_texts_of_the_same_facts(monkeypatch):
    worked_out, plain = [], prefilter.Need._met
    monkeypatch.setattr(prefilter.Need, "_met", lambda self, facts: worked_out.append(self) or plain(self, facts))
    monkeypatch.setattr(prefilter, "_verdicts", {})
    for k in range(50):
        fold.redact_text(f"Numer 777{'56789'[k % 5]}{'67'[k % 2]} i konto")
    assert len(worked_out) <= 2 * len(set(worked_out))  # while needs are made, facts are of some of their strings


def test_facts_of_digits():
    """Runs, chains and neighbours of digits, as they are defined sign by sign."""
    known, rng = persons.tags_of(fold._names(DEFAULT)).known, random.Random(7)
    letter = lambda c: bool(c) and bool(prefilter._LETTERS.match(c))
    for _ in range(3000):
        t = "".join(rng.choice("0123-. \naZłé") for _ in range(rng.randrange(0, 14)))
        runs = [m.span() for m in prefilter._DIGITS.finditer(t)]
        chains, last = [], 0
        for a, b in runs:
            near = bool(chains) and a - last <= prefilter.NEAR and not any(map(letter, t[last:a]))
            chains[len(chains) - near :] = [(chains[-1] if near else 0) + b - a]
            last = b
        sides = {c for a, b in runs for c in (t[a - 1 : a], t[b : b + 1])}
        facts = prefilter.Facts(t, known)
        assert (facts.run, facts.chain) == (max((b - a for a, b in runs), default=0), max(chains, default=0)), t
        assert (facts.mixed, facts.beside) == (any("A" <= c <= "Z" for c in sides), any(map(letter, sides))), t


def test_few_texts_need_many_rules(monkeypatch):
    """Plain prose is tried by few patterns."""
    tried = []
    monkeypatch.setattr(fold.State, "found", lambda self, rule, before: tried.append(rule) or [])
    fold.redact_text("The quick brown fox jumps over the lazy dog in 1999. " * 40)
    assert len(tried) <= 2


def _first(text, state):
    """The text before redaction, from what came out and the ledger."""
    out, at = [], 0
    for s in state.ledger.stretches:
        out += (state.text[at : s.start], text[s.first_start : s.first_end])
        at = s.end
    return "".join([*out, state.text[at:]])


@pytest.mark.parametrize("pseudonyms", [False, True])
def test_ledgers_lead_back(pseudonyms):
    for text in [*TEXTS, *mixed_texts(4, 1500)]:
        s = fold._state(text, None, None, pseudonyms, None, Ledger())
        assert _first(text, s) == text
        assert s.text == fold.redact_text(text, pseudonyms=pseudonyms)[0]
        assert [x.start for x in s.ledger.stretches] == sorted(x.start for x in s.ledger.stretches)
        places = fold.masked_places(text, pseudonyms=pseudonyms)
        assert all(text[a:b] == original for _, original, a, b in places)


def test_ledger_of_any_edits():
    """Many rounds of edits that may overlap earlier ones; places outside of stretches stay true."""
    rng = random.Random(5)
    for _ in range(400):
        first = text = "".join(rng.choice("abcdef") for _ in range(30))
        ledger = Ledger()
        for _ in range(4):
            cuts = sorted(rng.sample(range(len(text) + 1), min(6, len(text) + 1)))
            edits = [(a, b, rng.choice(["", "X", "YY", "ZZZZ"])) for a, b in zip(cuts[::2], cuts[1::2])]
            text = rewritten(text, edits)
            ledger.record(edits)
            at, whole = 0, []
            for s in ledger.stretches:
                whole += (text[at : s.start], first[s.first_start : s.first_end])
                at = s.end
            assert "".join([*whole, text[at:]]) == first
    ledger = Ledger()
    ledger.record([(0, 2, "u"), (5, 9, "")])  # u, three letters of the first text, what follows the ninth
    ledger.record([(1, 4, "v")])
    assert ledger.stretches == [Stretch(0, 1, 0, 2), Stretch(1, 2, 2, 5), Stretch(2, 2, 5, 9)]


def test_forms_are_readings_the_other_way():
    rng = random.Random(6)
    bases = sorted(DEFAULT.surnames)[::7] + ["kieł", "orzeł", "pies", "ab", "cki"]
    words = {f for b in bases for f in forms(b)} | {f[:-1] for b in bases for f in forms(b)} | {"".join(rng.choice("aeikmnosw") for _ in range(rng.randrange(3, 9))) for _ in range(3000)}
    table = {}
    for b in bases:
        for f in forms(b):
            table.setdefault(f, set()).add(b)
    for w in words:
        fit = {w, *(r.base for r in readings(w) if r.adjective or len(r.stem) >= KNOWN_STEM)}
        assert table.get(w, set()) == fit.intersection(bases), w


def test_names_with_and_without_kept_forms(monkeypatch):
    from zaslona.functions import morphology

    kept = Names(DEFAULT)
    assert kept.forms
    monkeypatch.setattr(morphology, "KEPT", 0)
    looked_up = Names(DEFAULT)
    assert looked_up.forms is None
    words = [w for t in TEXTS for w in t.split()] + sorted(kept.forms)[::11]
    for w in words:
        assert kept.base(w) == looked_up.base(w) and kept.is_first_name(w) == (w.lower() in name_forms(DEFAULT.name_stems, DEFAULT.first_names))
    for t in TEXTS[::3]:
        assert fold.redact_text(t, names=looked_up) == fold.redact_text(t, names=kept)


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([(1, "PESEL 44051401359, a@b.pl a@b.pl"), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("select id, s.* from texts, lateral pii_spans(text) s order by id, ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, "[PESEL]", 6, 17, "44051401359"), (1, 1, "[EMAIL]", 19, 25, "a@b.pl"), (1, 2, "[EMAIL]", 26, 32, "a@b.pl")]
    only = spark.sql("select s.mask from texts, lateral pii_spans(text, 'PESEL') s").collect()
    assert [r["mask"] for r in only] == ["[PESEL]"]
    named = spark.sql("select s.mask from texts, lateral pii_spans(text => 'Jan Kowalski', pseudonyms => true) s where id = 1").collect()
    assert [r["mask"] for r in named] == ["[OSOBA-A]"]
    for bad in ("pii_spans(text, 'NO')", "pii_spans(text, text)", "pii_spans(id)"):
        with pytest.raises(PySparkException):
            spark.sql(f"select * from texts, lateral {bad}").collect()


def test_places_of_links_and_labels(spark):
    text = "zob. https://x.pl/a?user=abc&pesel=123, krs  0000123456 i ul. Długa 5, 00-950 Nowy  Sącz"
    got = [(r["mask"], r["original"], r["start"]) for r in spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ord").collect()]
    want = [("[LOGIN]", "abc"), ("[PESEL]", "123"), ("[KRS]", "0000123456"), ("[ADRES]", "ul. Długa 5"), ("[KOD-POCZTOWY]", "00-950"), ("[MIEJSCOWOŚĆ]", "Nowy  Sącz")]
    assert [g[:2] for g in got[:5]] == want[:5] and [g[2] for g in got] == [text.index(g[1]) for g in got]
    assert got[-1][:2] in (want[-1], ("[MIEJSCOWOŚĆ]", "Nowy"))
