"""The command line: files, standard input, options, counts on standard error, exit codes; and sinks."""

import io
import json
import sys

import pytest

from zaslona import cli
from zaslona.sources import documents


class _Stdin:
    def __init__(self, data):
        self.buffer = io.BytesIO(data)


def test_files_are_one_document(tmp_path, capsys):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_bytes(b"\xef\xbb\xbfLogin: jkowal")
    b.write_text("wszedł jkowal, PESEL 44051401359 i a@b.pl", encoding="utf-8")
    assert cli.main([str(a), str(b)]) == 0
    out = capsys.readouterr()
    assert out.out == "Login: [LOGIN]\nwszedł [LOGIN], PESEL [PESEL] i [EMAIL]"
    assert out.err.strip() == "4: adres e-mail, login, PESEL"


def test_standard_input_and_a_file_for_the_result(tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(sys, "stdin", _Stdin("Jan Kowalski oraz Ewa Malinowska".encode()))
    for option in ("--persons", "--osoby", "--pseudonimy"):
        monkeypatch.setattr(sys, "stdin", _Stdin("Jan Kowalski oraz Ewa Malinowska".encode()))
        assert cli.main([option, "--out", str(tmp_path / "o.txt"), "-q"]) == 0
        assert (tmp_path / "o.txt").read_text(encoding="utf-8") == "[OSOBA-A] oraz [OSOBA-B]"
    out = capsys.readouterr()
    assert out.out == out.err == ""


def test_nothing_found(capsys, monkeypatch):
    monkeypatch.setattr(sys, "stdin", _Stdin(b"plain"))
    assert cli.main([]) == 0
    out = capsys.readouterr()
    assert out.out == "plain" and out.err.strip() == "nothing found"


def test_exit_codes(tmp_path, capsys):
    assert cli.main([str(tmp_path / "missing")]) == 1
    for bad in (["--unknown"], ["--out"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    assert e.value.code == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "[PESEL]"), (2, "x")], "id long, redacted string").coalesce(1)
    documents.write_text(df, str(tmp_path / "text"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["[PESEL]", "x"]
    documents.write_results(df, str(tmp_path / "rows"))
    lines = [json.loads(x) for p in (tmp_path / "rows").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [1, 2]
