"""Streams with state: restarts, late rows, labels that stay, and their end after a pause."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from zaslona.operators.fold import redact_text, redact_with_labels
from zaslona.streaming import files, redaction, state


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)


def rows(spark, *items):
    return spark.createDataFrame(list(items), "conv long, ts timestamp, turn long, text string").coalesce(1)


@pytest.fixture
def rocks(spark):
    spark.conf.set(files.STORE, files.ROCKS)
    yield
    spark.conf.unset(files.STORE)


def test_labels_shared_by_texts():
    labels = {}
    said = [redact_with_labels(t, labels)[0] for t in ("Pisze Ewa Malinowska i Jan Kowalski", "Pan Kowalski oraz Piotr Zieliński", "bez osób", None, "Anna Malinowska")]
    assert said == ["Pisze [OSOBA-A] i [OSOBA-B]", "Pan [OSOBA-B] oraz [OSOBA-C]", "bez osób", "", "[OSOBA-A]"]
    assert sorted(labels.values()) == ["A", "B", "C"]
    for t in ("Jan Kowalski i Ewa Malinowska, J. Kowalski", "Anna i Piotr Wiśniewscy"):
        assert redact_with_labels(t, {})[0] == redact_text(t, pseudonyms=True)[0]


def test_pseudonyms_over_arrivals_and_pauses(spark, rocks):
    build = lambda s: state.pseudonymised(s, "conv", "ts", "turn", late="1 minute", keep_seconds=600)
    arrivals = [
        rows(spark, (1, at(0), 1, "Jan Kowalski"), (1, at(1), 2, "Ewa Malinowska, a pan Kowalski nie"), (2, at(1), 1, "Ewa Malinowska"), (3, at(1), 1, None)),
        rows(spark, (1, at(3), 3, "pani Malinowska"), (2, at(30), 2, "Piotr Zieliński i Ewa Malinowska")),  # conversation 2 after a pause
        rows(spark, (1, at(40), 4, "pani Malinowska"), (2, at(5), 9, "Jan Kowalski")),  # conversation 1 forgotten; the second row is too late
    ]
    got = sorted((r["key"], r["place"], r["redacted"]) for r in files.replayed(arrivals, build).collect())
    assert got == [
        (1, 1, "[OSOBA-A]"),
        (1, 2, "[OSOBA-B], a pan [OSOBA-A] nie"),
        (1, 3, "pani [OSOBA-B]"),
        (1, 4, "pani [OSOBA-A]"),
        (2, 1, "[OSOBA-A]"),
        (2, 2, "[OSOBA-A] i [OSOBA-B]"),
        (3, 1, ""),
    ]


def test_late_rows_and_open_windows(spark):
    build = lambda s: redaction.windowed_findings(s, window="10 minutes", late="5 minutes", types=["EMAIL"]).select(F.unix_seconds("window.start").alias("start"), "total")
    mail = lambda m, n=1: (1, at(m), 1, "a@b.pl " * n)
    got = files.replayed([rows(spark, mail(1), mail(12, 2), mail(26)), rows(spark, mail(2), mail(13), mail(27)), rows(spark, mail(60))], build).collect()
    start = int(at(0).timestamp())
    # The watermark after the first arrival is 21: the second's rows of the first two windows are too late.
    assert sorted((r["start"] - start, r["total"]) for r in got) == [(0, 1), (600, 2), (1200, 2)]


def test_repeats_within_the_time(spark):
    build = lambda s: state.first_seen(s, "ts", ["text"], late="10 minutes").select("turn", "text")
    got = files.replayed([rows(spark, (1, at(0), 1, "a"), (1, at(1), 2, "b")), rows(spark, (1, at(2), 3, "a"), (1, at(2), 4, "c")), rows(spark, (1, at(50), 5, "d")), rows(spark, (1, at(51), 6, "a"))], build).collect()
    assert sorted((r["turn"], r["text"]) for r in got) == [(1, "a"), (2, "b"), (4, "c"), (5, "d"), (6, "a")]


def test_redaction_is_written_once(spark):
    parts = [rows(spark, (i, at(i), 1, f"x{i}@y.pl")) for i in range(3)]
    got = files.replayed(parts, lambda s: redaction.redact_stream(s, types=["EMAIL"]).select("conv", "redacted")).collect()
    assert sorted(map(tuple, got)) == [(0, "[EMAIL]"), (1, "[EMAIL]"), (2, "[EMAIL]")]


def test_sessions_that_are_open_when_rows_end_are_given(spark, tmp_path):
    from zaslona.plans import catalog

    seen = [(1, at(0), 7), (2, at(3), 7), (3, at(60), 7), (4, at(598), 7), (5, at(600), None), (6, at(600), 8)]
    spark.createDataFrame(seen, "event_id long, ts timestamp, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["st_sessions"](spark, str(tmp_path)).collect()
    assert sorted((r["user_id"] or 0, r["events"]) for r in got) == [(0, 1), (7, 1), (7, 1), (7, 2), (8, 1)]
