"""Checksums, morphology, spans, candidates, evaluation, views, sources, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from zaslona.cli import main
from zaslona.functions import checksums as C
from zaslona.functions.lexicon import DEFAULT
from zaslona.functions.morphology import Names, index_of, letters
from zaslona.functions.typography import tied
from zaslona.operators import candidates, evaluate, findings, relations, spans, traffic, views
from zaslona.operators.fold import redact_text
from zaslona.sources import documents, remote
from zaslona.streaming.redaction import sessions, windowed_findings


def test_checksums(spark):
    right = {"pesel": "44051401359", "nip": "5261040828", "regon9": "123456785", "regon14": "12345678512347", "card": "4111 1111 1111 1111", "dowod": "ABA300000", "iban": "PL61 1090 1014 0000 0712 1981 2874"}
    tests = {"pesel": C.is_pesel, "nip": C.is_nip, "regon9": C.is_regon9, "regon14": C.is_regon14, "card": C.is_card, "dowod": C.is_dowod, "iban": C.is_iban}
    columns = {k: (lambda c, k=k: C.weighted_column(k, c)) for k in C.WEIGHTED} | {"card": C.card_column, "dowod": C.dowod_column, "iban": C.iban_column}
    for kind, value in right.items():
        wrong = value[:-1] + str((int(value[-1]) + 1) % 10)
        for v, want in ((value, True), (wrong, False), ("", False), ("x", False)):
            assert tests[kind](v) == want, (kind, v)
        df = spark.createDataFrame([(value,), (wrong,), ("",), ("ą1",), (None,)], "v string")
        assert [r[0] for r in df.select(columns[kind](F.col("v"))).collect()] == [True, False, False, False, False], kind
    assert not C.is_nip("123456780" + "0")


def test_morphology():
    n = Names()
    assert n.is_first_name("Anną") and n.is_first_name("Janem") and not n.is_first_name("Stołu")
    assert n.base("Kowalskiego") == "kowalski" and n.base("Nowakowi") == "nowak" and n.base("Stołek") is None
    assert n.key("Gzowskiego") == n.key("Gzowski") == "gzowski"
    assert n.like_surname("Gzowska") and not n.like_surname("Warszawskiego") and n.of_a_place("Śląskiej")
    assert [letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(index_of(letters(i)) == i for i in range(2000))
    assert Names(DEFAULT.with_words(surnames=["Abacki"])).base("abackiemu") == "abacki"


def test_person_spans(spark):
    text = "Wczoraj Gzowski i [PESEL] oraz <Nowak> z Lis."
    tok = lambda w, s=0.9, e="B-PER", **k: {"entity": e, "word": w, "score": s, **k}
    assert spans.person_spans(text, [tok("Gz"), tok("owski")]) == [(8, 15)]
    assert spans.person_spans(text, [tok("Gzowski", 0.4)]) == []
    assert spans.person_spans(text, [tok("Nowak"), tok("x", e="O"), tok("Lis")]) == []
    assert spans.person_spans(text, [tok("Lis")], homograph_least=0.8) == [(41, 44)]
    assert spans.person_spans(text, [tok("?", start=9, end=11)]) == [(8, 15)]
    assert spans.merged_intervals([(3, 5), (0, 2), (2, 3), (7, 9)]) == [(0, 5), (7, 9)]
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (2, 1, 2)], "doc_id long, start long, end long")
    assert sorted(map(tuple, spans.merge_intervals(df, "doc_id").collect())) == [(1, 0, 7), (1, 9, 10), (2, 1, 2)]
    assert spans.overlapping(df, df, "doc_id").count() == 4


def test_candidates(spark):
    df = spark.createDataFrame([(1, "Ala ma [NIP] i Ola", ["Ala", "x", "NIP", "brak", "Ala", "Ola", None]), (2, "tekst", None), (3, None, ["a"])], "id long, text string, candidates array<string>")
    got = {r["id"]: (r["redacted"], r["hits"]) for r in candidates.mask_candidates(df).collect()}
    assert got == {1: ("[IMIĘ I NAZWISKO] ma [NIP] i [IMIĘ I NAZWISKO]", 2), 2: (None, 0), 3: (None, 0)}


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "basic", ["a"], ["b"], "b"), (2, "basic", ["a"], [], "a"), (3, "negative", [], ["b"], "")], "id long, category string, must_mask array<string>, must_keep array<string>, redacted string")
    cases = evaluate.evaluated(df)
    rates = {r["category"]: r for r in evaluate.metrics(cases).collect()}
    assert rates["basic"]["recall"] == 0.5 and rates["negative"]["recall"] is None and rates[None]["precision"] == 0.5
    assert evaluate.failures(cases).count() == 2
    assert evaluate.gate(evaluate.metrics(cases)) and "| all |" in evaluate.report(evaluate.metrics(cases))
    assert evaluate.changed(df, df.withColumn("redacted", F.lit("b"))).first()[0] == 2


def test_views():
    assert views.replaced("PESEL 44051401359 i a@b.pl", "PESEL [PESEL] i [EMAIL]") == [("[PESEL]", "44051401359"), ("[EMAIL]", "a@b.pl")]
    assert views.replaced("x", "x") == []
    assert tied("<a b='i o'>Ala i kot</a><script>a i b</script>") == "<a b='i o'>Ala i kot</a><script>a i b</script>"
    assert findings.types_of({}) is None and "EMAIL" not in findings.types_of({"contact": False})


def test_sources(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>A &amp; b</w:t><w:tab/><w:t xml:space='preserve'>c</w:t></w:p><w:p><w:t>d</w:t></w:p>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes("﻿żółw".encode())
    rows = {r["path"][-6:]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.docx"]["text"] == "A & b\tc\nd" and rows["b.docx"]["error"] and rows["/c.txt"]["text"] == "żółw"
    assert documents.joined(documents.read_text(spark, str(tmp_path / "c.txt"))).first()[0] == "żółw"


def test_breaker_and_layers(spark):
    from zaslona.sources import remote

    now = [0.0]
    b = remote.Breaker(clock=lambda: now[0])
    for _ in range(3):
        assert b.allows("u")
        b.failed("u")
    assert not b.allows("u")
    now[0] = 31
    assert b.allows("u")
    b.failed("u")
    assert not b.allows("u")
    now[0] = 62
    assert b.allows("u")
    b.succeeded("u")
    assert b.allows("u")
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, redacted string")
    got = {r["id"]: (r["ner"], r["ner_note"]) for r in remote.ner_layer(df, "http://x", send=lambda *a: {"redacted": "X"}).collect()}
    assert got == {1: ("X", None), 2: (None, None), 3: ("", None)}
    assert remote.llm_layer(df, lambda t: [t, 1]).where("id = 1").first()["candidates"] == ["abc"]
    assert remote.llm_layer(df.limit(0), lambda t: [t]).count() == 0


def test_course_of_requests():
    import time
    from threading import Lock

    from zaslona.sources import remote

    now, most, lock = [0], [0], Lock()

    def call(text):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.03 - 0.001 * int(text))
        with lock:
            now[0] -= 1
        return text

    texts = [str(i) for i in range(25)] + [None, ""]
    got = list(remote.Course("u", call, at_once=5).answers(texts))
    assert [g[0] for g in got] == [*map(str, range(25)), None, None] and 2 <= most[0] <= 5
    asked = []

    def fail(text):
        asked.append(text)
        raise OSError

    got = list(remote.Course("u", fail, at_once=1, tries=1, wait=0).answers("abcdefgh"))
    assert [g[1] for g in got] == ["failed: OSError"] * 3 + ["breaker open"] * 5 and asked == list("abc")
    asked.clear()
    assert [g[1] for g in remote.Course("u", fail, probe=lambda: False).answers(["a", None])] == ["skipped: no answer to the probe", None] and not asked
    list(remote.Course("u", lambda t: asked.append(t), probe=lambda: True, warm_up="warm").answers(["a"]))
    assert asked == ["warm", "a"]


def test_masks_are_located():
    text = "KRS nr 0000123456, Jan  Kowalski, ul. Długa 5"
    red = redact_text(text)[0]
    got = views.located(text, red)
    assert [text[a:b] for _, _, a, b in got] == [o for _, o, _, _ in got] and got[0][1:] == ("0000123456", 7, 17)
    # Parts that are written otherwise afterwards do not hide the masks behind them.
    assert [m for m, *_ in views.located("krs nr 0000123456 x 44051401359 y", "KRS nr [KRS] x [PESEL] y")] == ["[KRS]", "[PESEL]"]
    assert [r[:2] for r in views.located("a b c", "a [PESEL] ZZ [NIP] c")] == [("[PESEL]", "b"), ("[NIP]", "b")]


def test_relations(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 2, 2), ("b", 9, 3), ("c", 1, 4), (None, 1, 5), ("a", None, 6)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 4, 40), ("a", 4, 41), ("b", 10, 90), (None, 0, 7)], "k string, at int, v int")
    assert {r["id"]: r["v"] for r in relations.as_of(left, right, "k", "at", ["v"]).collect()} == {1: 41, 2: 20, 3: None, 4: None, 5: None, 6: None}
    assert relations.as_of(left.limit(0), right, "k", "at", ["v"]).count() == 0
    texts = spark.createDataFrame([(1, "abc"), (2, None), (3, "xyz")], "id int, t string")
    assert sorted((r["id"], r["rule"]) for r in relations.matching(texts, "t", {"a": "^a", "c": "c$", "x": "q"}).collect()) == [(1, "a"), (1, "c")]
    assert relations.matching(texts, "t", {}).count() == 0
    with pytest.raises(ValueError):
        relations.matching(texts, "t", {str(i): "x" for i in range(2000)})


def test_many_texts_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(documents, "JOIN_LIMIT", 4)
    with pytest.raises(ValueError):
        documents.joined(spark.createDataFrame([("a", "xyz"), ("b", "xyz")], "path string, text string"))


def test_traffic(spark):
    e = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-02 10:00:00", "a", 2.0), ("2024-01-02 11:00:00", "b", 3.0)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [r["events"] for r in traffic.trend(e).collect()] == [1, 2]
    assert traffic.breakdown(e, "kind", 1).first()["dimension"] == "a" and traffic.breakdown(e, "no").count() == 0
    assert traffic.summary(traffic.between(e, "2024-01-02", "2024-01-03")).first()[0] == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:01:00", "a@b.pl"), ("2024-01-01 10:02:00", "c@d.pl e@f.pl"), ("2024-01-01 11:00:00", "g@h.pl")], "ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    for name, df in (("w", windowed_findings(stream)), ("s", sessions(stream, "text"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r["total"] for r in spark.table("w").collect()] == [3]
    assert spark.table("s").count() >= 2


def test_command_line(tmp_path, capsys):
    (tmp_path / "a").write_text("PESEL 44051401359", encoding="utf-8")
    (tmp_path / "b").write_text("Jan Kowalski", encoding="utf-8")
    assert main([str(tmp_path / "a"), str(tmp_path / "b"), "--persons"]) == 0
    out = capsys.readouterr()
    assert out.out == "PESEL [PESEL]\n[OSOBA-A]" and "2: PESEL, imię i nazwisko" in out.err
    assert main([str(tmp_path / "no")]) == 1
    with pytest.raises(SystemExit) as e:
        main(["--no-such"])
    assert e.value.code == 2


def test_registered_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "f_by_lang_rollup" in entry.queries()


def test_flagship(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    assert set(entry.entry(spark).columns) == {"lang", "type", "total"}


def test_synthetic(spark):
    from zaslona.sources import synthetic as S

    g = S.mulberry32(1)
    assert [round(next(g), 6) for _ in range(2)] == [0.627074, 0.002736]
    tests = {"pesel": C.is_pesel, "nip": C.is_nip, "regon9": C.is_regon9, "regon14": C.is_regon14, "card": C.is_card, "dowod": C.is_dowod, "nrb": lambda v: C.is_iban("PL" + v)}
    for kind, right in tests.items():
        for r in S.numbers(spark.range(1, 40), "id", kind).collect():
            assert right(r["value"]) == (r["id"] % 2 == 0), (kind, r)


def test_layers(spark):
    from zaslona.operators.layers import redact_layers

    df = spark.createDataFrame([(1, "PESEL 44051401359 Smith i Stone")], "id long, text string")
    send = lambda url, body, *a: {"redacted": body["text"].replace("Smith", "[IMIĘ I NAZWISKO]")}
    r = redact_layers(df, ner_url="http://x", ask=lambda t: ["Stone", "PESEL"], send=send).first()
    assert r["redacted"] == "PESEL [PESEL] [IMIĘ I NAZWISKO] i [IMIĘ I NAZWISKO]"
    assert [tuple(f) for f in r["found"]] == [("PESEL", 1), ("IMIE", 2)]

    def broken(*a):
        raise OSError

    r = redact_layers(df, ner_url="http://y", ask=broken, send=broken).first()
    assert r["redacted"] == "PESEL [PESEL] Smith i Stone"


def test_intervals_given_twice_merge_in_any_order(spark):
    df = spark.createDataFrame([(1, 10, 20), (1, 0, 5), (1, 10, 20), (1, 20, 25), (2, 3, 4), (2, 3, 4)], "doc_id long, start long, end long")
    for rows in (df, df.orderBy(F.desc("end")), df.repartition(3)):
        assert sorted(map(tuple, spans.merge_intervals(rows, "doc_id").collect())) == [(1, 0, 5), (1, 10, 25), (2, 3, 4)]
