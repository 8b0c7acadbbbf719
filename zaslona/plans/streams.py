"""Registered queries on streams: state, late rows, restarts, and results read back from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import files, redaction, state
from .cases import dealt
from .more import query, table

_BY_HOUR = "date_trunc('hour', ts)"


@query("st_redacted", "select c_custkey, 'PESEL [PESEL] ' || c_custkey as redacted from customer")
def st_redacted(spark, sf_dir):
    """Three arrivals, the stream started anew for each; every row is written once."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'PESEL 44051401458 ' || c_custkey as text")
    return files.replayed([rows.where(F.col("c_custkey") % 3 == i) for i in range(3)], lambda s: redaction.redact_stream(s, types=["PESEL"]).select("c_custkey", "redacted"))


# Three arrivals, and a watermark two hours behind the latest row: what comes in an hour that an earlier arrival's
# watermark has closed is too late. Windows that the last watermark has not reached are not written yet.
_LATE = "interval 2 hours"
_WINDOWS = f"""with e as (select *, event_id % 3 as arrival, {_BY_HOUR} as start from events),
mark as (select max(ts) filter (arrival = 1) - {_LATE} as one, max(ts) filter (arrival <> 0) - {_LATE} as two, max(ts) - {_LATE} as last from e)
select start, 'PESEL' as type, count(*) as total from e, mark
where (arrival = 1 or start + interval 1 hour > case arrival when 2 then one else two end) and start + interval 1 hour <= last group by start"""


def _arrivals(spark, sf_dir, *columns):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts", *columns)
    return [rows.where(F.col("event_id") % 3 == i) for i in (1, 2, 0)]


@query("st_windows", _WINDOWS)
def st_windows(spark, sf_dir):
    """Findings by hour; rows that come after their hour was closed do not count."""
    build = lambda s: redaction.windowed_findings(s, window="1 hour", late="2 hours", types=["PESEL"]).select(F.col("window.start").alias("start"), "type", "total")
    out = files.replayed(_arrivals(spark, sf_dir, "'PESEL 44051401458' as text"), build)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "type", F.col("total").cast("long").alias("total"))


@query("st_sessions", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 5 minutes then 0 else 1 end as fresh from events),
s as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from e)
select user_id, count(*) as events from s group by user_id, n""")  # fmt: skip
def st_sessions(spark, sf_dir):
    """All sessions; those that the watermark has not closed when the rows end are closed by a later row of no user's."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "cast(ts as timestamp) as ts", "false as closing")
    end = rows.agg(F.max("ts").alias("ts")).where("ts is not null").selectExpr("cast(null as bigint) as user_id", "ts + interval 1 day as ts", "true as closing")
    # The later row is left out of what is read back: a filter within the stream would keep it from moving the watermark.
    build = lambda s: redaction.sessions(s, ["user_id", "closing"], late="2 hours").select("user_id", "events", "closing")
    return files.replayed([rows, end], build).where("not closing").select("user_id", "events")


# Each user's events in order of time name one of four persons, or the last one in another form.
_PEOPLE = ["pan Jan Kowalski", "pani Ewa Malinowska", "pana Kowalskiego", "pan Piotr Zieliński"]
_WHO = [0, 1, 0, 2]
_TEXT = f"'Pisze ' || {dealt(_PEOPLE).replace('c_custkey', 'event_id')} || ' nr ' || event_id"
_SAID = "Pisze pan ", "Pisze pani ", "Pisze pana ", "Pisze pan "


@query("st_pseudonyms", f"""with e as (select user_id, event_id, ts, cast(event_id % 4 as integer) as which, {dealt([str(w) for w in _WHO], str).replace('c_custkey', 'event_id')} as who,
    case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 days then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from e),
f as (select user_id, n, who, min(struct_pack(t := ts, i := event_id)) as first from s group by user_id, n, who),
l as (select user_id, n, who, dense_rank() over (partition by user_id, n order by first) as label from f)
select user_id, event_id, {dealt(list(_SAID)).replace('c_custkey', 'event_id')} || '[OSOBA-' || chr(cast(64 + label as integer)) || '] nr ' || event_id as redacted from s join l using (user_id, n, who)""")  # fmt: skip
def st_pseudonyms(spark, sf_dir):
    """A person has one label in all of a user's texts, over two arrivals and a restart."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "cast(ts as timestamp) as ts", f"{_TEXT} as text")
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5).alias("at")).head()["at"]
    before = spark.conf.get(files.STORE, None)
    spark.conf.set(files.STORE, files.ROCKS)
    try:
        build = lambda s: state.pseudonymised(s, "user_id", "ts", "event_id", late="1 hour", keep_seconds=30 * 86400)
        out = files.replayed([rows.where(F.unix_micros("ts") <= middle), rows.where(F.unix_micros("ts") > middle)], build)
    finally:
        spark.conf.set(files.STORE, before) if before else spark.conf.unset(files.STORE)
    return out.select(F.col("key").alias("user_id"), F.col("place").alias("event_id"), "redacted")


@query("st_first_seen", """with e as (select event_type, user_id, ts, ts - lag(ts) over (partition by event_type, user_id order by ts) as gap from events)
select event_type, user_id, true as seen from e group by event_type, user_id""")  # fmt: skip
def st_first_seen(spark, sf_dir):
    """Users' kinds of events, each once: what repeats within the time is dropped."""
    build = lambda s: state.first_seen(s.select("event_type", "user_id", "ts"), "ts", ["event_type", "user_id"], late="10000 days").select("event_type", "user_id", F.lit(True).alias("seen"))
    return files.replayed(_arrivals(spark, sf_dir, "event_type"), build)
