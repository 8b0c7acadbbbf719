"""Further registered queries: single rules, layers, sources, views, relations and streams."""

from __future__ import annotations

import io
import time
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import DEFAULT
from ..functions.morphology import Names
from ..operators import evaluate, findings, relations, spans, traffic, views
from ..operators.layers import redact_layers
from ..operators.redact import redact
from ..operators.redact import spans as masked_spans
from ..operators.rules import escaped_column
from ..sources import documents, remote, synthetic
from . import recall
from .cases import CASES, _literal, dealt

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _total(found):
    return F.aggregate(found, F.lit(0), lambda a, f: a + f["count"])


# Single rules

for _name, (_kinds, _rows) in CASES.items():

    def _one_rule(spark, sf_dir, kinds=_kinds, rows=_rows):
        df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{dealt([t for t, _, _ in rows])} as text")
        return redact(df, types=kinds).select("c_custkey", "redacted", _total(F.col("found")).alias("n"))

    query(_name, f"select c_custkey, {dealt([e for _, e, _ in _rows])} as redacted, cast({dealt([n for _, _, n in _rows], str)} as integer) as n from customer")(_one_rule)


# Words: (word, base, key, like a surname, adjective of a place, first name)
_WORDS = [
    ("Kowalskiego", "kowalski", "kowalski", True, False, False),
    ("Nowakowi", "nowak", "nowak", False, False, False),
    ("Kurka", None, "kurk", False, False, False),
    ("Brzezickiej", None, "brzezicki", True, False, False),
    ("Krakowskiego", None, "krakowski", False, True, False),
    ("Zielińscy", "zieliński", "zieliński", True, False, False),
    ("Annie", None, "anni", False, False, True),
    ("Stankiewiczem", "stankiewicz", "stankiewicz", True, False, False),
    ("Ski", None, "ski", False, False, False),
    ("Śląska", None, "śląski", False, True, False),
]
_TEXT = lambda x: "null" if x is None else _literal(x)
_FLAG = lambda x: str(x).lower()


@query("m_words", f"select c_custkey, {dealt([w[0] for w in _WORDS])} as word, " + ", ".join(f"{dealt([w[i] for w in _WORDS], _TEXT if i < 3 else _FLAG)} as {n}" for i, n in enumerate(("base", "key", "like_surname", "of_a_place", "first_name"), 1)) + " from customer")
def m_words(spark, sf_dir):
    """What the forms of names are."""

    @F.pandas_udf("struct<base string, key string, like_surname boolean, of_a_place boolean, first_name boolean>")
    def facts(words: pd.Series) -> pd.DataFrame:
        n = Names(DEFAULT)
        return pd.DataFrame([(n.base(w), n.key(w), n.like_surname(w), n.of_a_place(w), n.is_first_name(w)) for w in words], columns=["base", "key", "like_surname", "of_a_place", "first_name"])

    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{dealt([w[0] for w in _WORDS])} as word")
    return df.withColumn("f", facts("word")).select("c_custkey", "word", "f.*")


_SIGNS = "p_name || ' (' || p_partkey || ') [a-b] c.d*e+f? ^$ {x}|y \\\\ z/'"


@query("m_escaped", "select p_partkey, regexp_replace(" + _SIGNS.replace("\\\\", "\\") + r""", '([.*+?^${}()|\[\]\\/-])', '\\\1', 'g') as pattern from part""")
def m_escaped(spark, sf_dir):
    """Names with signs of their own, as patterns that match just them."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SIGNS} as t").select("p_partkey", escaped_column(F.col("t")).alias("pattern"))


# A classifier's tokens: (text, [(entity, word, score, start, end)], expected)
_NER = {
    "n_offsets": [("Pan Smith był", [("B-PER", "x", 0.9, 4, 9)], "Pan [IMIĘ I NAZWISKO] był"), ("Pan Smith był", [("B-PER", "x", 0.9, 5, 7)], "Pan [IMIĘ I NAZWISKO] był")],
    "n_stopword": [("Sąd Rejonowy orzekł", [("B-PER", "Sąd Rejonowy", 0.9, None, None)], "Sąd Rejonowy orzekł")],
    "n_homograph": [("widziano Mroza wczoraj", [("B-PER", "Mróz", 0.99, None, None)], "widziano Mroza wczoraj"), ("widziano wilk wczoraj", [("B-PER", "wilk", 0.99, None, None)], "widziano wilk wczoraj")],
    "n_word_growth": [("mówił Smith-Jones dziś", [("nam_liv_person", "Smith", 0.9, None, None)], "mówił [IMIĘ I NAZWISKO] dziś")],
    "n_recheck": [("był smithson i Smith", [("B-PER", "smith", 0.9, None, None)], "był smithson i Smith"), ("był Smithson dziś", [("persName", "Smith", 0.9, None, None)], "był [IMIĘ I NAZWISKO] dziś")],
    "n_masks_closed": [("jest [PESEL] Smith", [("B-PER", "PESEL", 0.9, None, None), ("O", "x", 1.0, None, None), ("B-PER", "Smith", 0.9, None, None)], "jest [PESEL] [IMIĘ I NAZWISKO]")],
    "n_order": [("Smith, Smith i Smith", [("B-PER", "Smith", 0.9, None, None), ("O", "x", 1.0, None, None), ("B-PER", "Smith", 0.9, None, None)], "[IMIĘ I NAZWISKO], [IMIĘ I NAZWISKO] i Smith")],
}


def _tokens(rows) -> str:
    one = lambda t: f"struct('{t[0]}' as entity, '{t[1]}' as word, cast({t[2]} as double) as score, cast(null as int) as index, cast({'null' if t[3] is None else t[3]} as int) as start, cast({'null' if t[4] is None else t[4]} as int) as end)"
    return dealt([r[1] for r in rows], lambda ts: f"array({', '.join(map(one, ts))})")


for _name, _rows in _NER.items():

    def _classified(spark, sf_dir, rows=_rows):
        df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{dealt([r[0] for r in rows])} as text", f"{_tokens(rows)} as tokens")
        return spans.redact_persons(df).select("c_custkey", "redacted")

    query(_name, f"select c_custkey, {dealt([r[2] for r in _rows])} as redacted from customer")(_classified)


@query("n_predicates", "select c_custkey, 'mówił [IMIĘ I NAZWISKO] i Jones' as redacted from customer")
def n_predicates(spark, sf_dir):
    """Own predicates in place of the standard ones."""
    rows = [("mówił Smith i Jones", [("X", "Smith", 0.1, None, None), ("O", "x", 1.0, None, None), ("X", "Jones", 0.1, None, None)], "")]
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{dealt([rows[0][0]])} as text", f"{_tokens(rows)} as tokens")
    return spans.redact_persons(df, least=0.0, person=lambda e: e == "X", stopword=lambda w: w == "Jones", homograph=lambda w: False).select("c_custkey", "redacted")


# Layers behind services, with stand-ins for these

_LAYERED = "'PESEL 44051401458, ' || 'pisze Smith z Umbra ' || c_custkey"


def _send(url, body, timeout, key=None):
    return {"redacted": body["text"].replace("Smith", "[IMIĘ I NAZWISKO]")}


def _lost(*_):
    raise OSError("no service")


@query("l_ner_layer", "select c_custkey, 'PESEL [PESEL], pisze [IMIĘ I NAZWISKO] z Umbra ' || c_custkey as redacted, cast(2 as integer) as n from customer")
def l_ner_layer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_LAYERED} as text")
    return redact_layers(df, ner_url="http://ner", send=_send).select("c_custkey", "redacted", _total(F.col("found")).alias("n"))


@query("l_all_layers", "select c_custkey, 'PESEL [PESEL], pisze [IMIĘ I NAZWISKO] z [IMIĘ I NAZWISKO] ' || c_custkey as redacted, cast(3 as integer) as n from customer")
def l_all_layers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_LAYERED} as text")
    return redact_layers(df, ner_url="http://ner", send=_send, ask=lambda text: ["Umbra", "PESEL", "x"]).select("c_custkey", "redacted", _total(F.col("found")).alias("n"))


@query("l_layer_lost", "select c_custkey, 'PESEL [PESEL], pisze Smith z Umbra ' || c_custkey as redacted from customer")
def l_layer_lost(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_LAYERED} as text")
    return redact_layers(df, ner_url="http://lost", send=_lost, ask=_lost).select("c_custkey", "redacted")


@query("l_long_text", f"select c_custkey, {remote.NER_CHARS + 10} - 5 + 17 - 5 as n, repeat('a', 5) || '[IMIĘ I NAZWISKO]' || c_custkey % 10 || 'Smith' as tail from customer".replace(f"{remote.NER_CHARS + 10} - 5 + 17 - 5", str(remote.NER_CHARS - 5 + 17 + 1 + 5)))
def l_long_text(spark, sf_dir):
    """The service sees the first characters only; the rest stays behind them."""
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"repeat('a', {remote.NER_CHARS - 6}) || 'aSmith' || c_custkey % 10 || 'Smith' as text")
    done = remote.ner_layer(df, "http://ner", "text", send=_send)
    return done.select("c_custkey", F.length("ner").alias("n"), F.right("ner", F.lit(28)).alias("tail"))


_WAITED, _AGAIN = "c_custkey % 60", "c_custkey % 7 * 10"


@query("l_breaker", f"select c_custkey, 'ok,ok,open,' || case when {_WAITED} < 30 then 'open' else 'trial,' || case when {_AGAIN} < 30 then 'open' else 'trial' end end as course from customer")
def l_breaker(spark, sf_dir):
    """Three failures one after another, a wait that each row has of its own, and if it was long enough a failed trial and another wait."""

    @F.pandas_udf("string")
    def course(waited: pd.Series, again: pd.Series) -> pd.Series:
        def one(first, second):
            now, out = [0.0], []
            b = remote.Breaker(clock=lambda: now[0])
            for _ in range(3):
                b.failed("u")
                out.append("ok" if b.allows("u") else "open")
            now[0] = float(first)
            out.append("trial" if b.allows("u") else "open")
            if out[-1] == "trial":
                b.failed("u")
                now[0] += float(second)
                out.append("trial" if b.allows("u") else "open")
            return ",".join(out)

        return pd.Series([one(a, b) for a, b in zip(waited, again)])

    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_WAITED} as waited", f"{_AGAIN} as again")
    return df.select("c_custkey", course("waited", "again").alias("course"))


_seen: set = set()


def _slow(text: str) -> str:
    """A service that takes longer for some, fails always for others, and once for a third kind."""
    key = int(text.split()[-1])
    if key % 7 == 0:
        raise OSError("lost")
    if key % 5 == 0 and text not in _seen:
        _seen.add(text)
        raise OSError("lost once")
    time.sleep(key % 3 / 1000)
    return text.upper()


@query("l_at_once", """select c_custkey, case when c_custkey % 7 = 0 then null else 'NR ' || c_custkey end as answer, case when c_custkey % 7 = 0 then 'failed: OSError' end as answer_note,
    cast(case when c_custkey % 7 = 0 or c_custkey % 5 = 0 then 2 else 1 end as integer) as answer_tries from customer""")  # fmt: skip
def l_at_once(spark, sf_dir):
    """Several requests of a task under way: answers stay with their rows, failures are asked again."""
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'nr ' || c_custkey as text")
    done = remote.asked(df, "text", "answer", T.StringType(), "http://slow", _slow, at_once=6, wait=0.0, breaker=remote.Breaker(clock=lambda: float("inf")))
    return done.select("c_custkey", "answer", "answer_note", "answer_tries")


@query("l_skipped", "select 'skipped: no answer to the probe' as note, count(*) as rows, cast(0 as bigint) as tries from customer")
def l_skipped(spark, sf_dir):
    """A service that does not answer the probe is left out, and the rows say so."""
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'nr ' || c_custkey as text")
    return remote.notes(remote.asked(df, "text", "answer", T.StringType(), "http://gone", _slow, probe=lambda: False), "answer")


# Evaluation

_CATEGORIES = ["structural", "basic", "rare"]
_CASE_OF = f"case {' '.join(f'when c_custkey % 3 = {i} then {c!r}' for i, c in enumerate(_CATEGORIES))} end"


def _judged(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{_CASE_OF} as category", "array('44051401458') as must_mask", "array('akta') as must_keep", "'PESEL 44051401458, akta ' || c_custkey as text")
    return evaluate.evaluated(redact(df))


@query("e_changed", "select count(*) filter (c_custkey % 4 = 0) as changed from customer")
def e_changed(spark, sf_dir):
    core = _judged(spark, sf_dir).select("id", "redacted")
    return evaluate.changed(core, core.withColumn("redacted", F.when(F.col("id") % 4 == 0, F.lit("x")).otherwise(F.col("redacted"))))


@query("e_gate", "select count(*) filter (false) as faults from customer")
def e_gate(spark, sf_dir):
    """Nothing falls short over these cases."""
    return evaluate.gate_faults(evaluate.metrics(_judged(spark, sf_dir))).agg(F.count("*").alias("faults"))


_SHORT = """with c as (select case c_custkey % 4 when 0 then 'basic' when 1 then 'inflected' when 2 then 'structural' else 'other' end as category, c_custkey % 12 = 4 as leaks, c_custkey % 5 = 0 as eats from customer),
r as (select category, 1 - count(*) filter (leaks) / count(*) as recall, 1 - count(*) filter (eats) / count(*) as precision from c group by rollup (category))
select case when category is null then 'precision ' || format('{:.3f}', precision) else 'recall of ' || category || ' ' || format('{:.3f}', recall) end as fault
from r where category is null and precision < 0.98 or category in ('basic', 'inflected', 'rare', 'structural', 'dictionary') and recall < 1"""


@query("e_gate_fails", _SHORT)
def e_gate_fails(spark, sf_dir):
    """Cases of which some leak and some lose what should stay."""
    category = "case c_custkey % 4 when 0 then 'basic' when 1 then 'inflected' when 2 then 'structural' else 'other' end"
    text = "concat(case when c_custkey % 12 = 4 then '44051401459' else 'PESEL 44051401458' end, case when c_custkey % 5 = 0 then ' a@b.pl' else ' akta' end)"
    mask, keep = "array(case when c_custkey % 12 = 4 then '44051401459' else '44051401458' end)", "array(case when c_custkey % 5 = 0 then 'a@b.pl' else 'akta' end)"
    made = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", f"{category} as category", f"{mask} as must_mask", f"{keep} as must_keep", f"{text} as text")
    return evaluate.gate_faults(evaluate.metrics(evaluate.evaluated(redact(made))))


@query("e_first_seen", f"select category, cast(row_number() over (order by min(c_custkey)) as integer) as place from (select c_custkey, {_CASE_OF} as category from customer) group by category")
def e_first_seen(spark, sf_dir):
    return evaluate.category_order(_judged(spark, sf_dir), "id")


# Sources


@query("s_docx", "select c_custkey, 'Pan ' || c_name || chr(10) || 'tab' || chr(9) || 'a & b' as text from customer")
def s_docx(spark, sf_dir):
    """Word files, made here, as text."""

    @F.pandas_udf("binary")
    def made(names: pd.Series) -> pd.Series:
        def one(name):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document><w:p><w:r><w:t>Pan </w:t><w:t xml:space='preserve'>{name}</w:t></w:r></w:p><w:p><w:t>tab</w:t><w:tab/><w:t>a &amp; b</w:t></w:p></w:document>")
            return out.getvalue()

        return pd.Series([one(n) for n in names], dtype=object)

    files = table(spark, sf_dir, "customer").select("c_custkey", F.lit("a.DOCX").alias("path"), made("c_name").alias("content"))
    return documents.extracted(files).select("c_custkey", "text")


@query("s_dispatch", "select c_custkey, case c_custkey % 3 when 0 then 'tekst ' || c_custkey end as text, case c_custkey % 3 when 1 then 'not a .docx file' when 2 then 'unreadable PDF' end as error from customer")
def s_dispatch(spark, sf_dir):
    """Files by extension; what is no document of its kind has an error and no text."""
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 3 when 0 then 'a.txt' when 1 then 'b.docx' else 'c.pdf' end as path", "unhex('EFBBBF') || cast('tekst ' || c_custkey as binary) as content")
    return documents.extracted(files).select("c_custkey", "text", F.when(F.col("error").contains("PDF"), "unreadable PDF").otherwise(F.col("error")).alias("error"))


@query("s_joined", "select string_agg(r_name, chr(10) order by r_regionkey) as text from region")
def s_joined(spark, sf_dir):
    """A few texts as one, in the order of their paths."""
    return documents.joined(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("path"), F.col("r_name").alias("text")))


@query("s_numbers", "select o_orderkey, substr(value, 1, length(value) - 1) || cast((cast(right(value, 1) as integer) + 1) % 10 as varchar) as flipped, o_orderkey % 2 = 0 as valid from (" + synthetic.VALUES["pesel"] + ") v")
def s_numbers(spark, sf_dir):
    """Made-up numbers and the same with another last digit."""
    from ..functions.checksums import weighted_column

    made = synthetic.numbers(table(spark, sf_dir, "orders"), "o_orderkey", "pesel")
    return made.select("o_orderkey", synthetic.flip_last_digit(F.col("value")).alias("flipped"), weighted_column("pesel", F.col("value")).alias("valid"))


@query("s_fours", "select o_orderkey, trim(regexp_replace(value, '(.{4})', '\\1 ', 'g')) as spaced from (" + synthetic.VALUES["nrb"] + ") v")
def s_fours(spark, sf_dir):
    return synthetic.numbers(table(spark, sf_dir, "orders"), "o_orderkey", "nrb").select("o_orderkey", synthetic.in_fours(F.col("value")).alias("spaced"))


# The generator in 128-bit whole numbers, as its definition has it.
def _drawn(i: str) -> str:
    word, times = "4294967295", lambda a, b: f"((({a})::hugeint * ({b})::hugeint) % 4294967296)::bigint"
    a = f"(({synthetic.SEED} + ({i} + 1)::hugeint * 1831565813) % 4294967296)::bigint"
    return f"(with g as (select {a} as a), t as (select {times('xor(a, a >> 15)', 'a | 1')} as t from g), u as (select xor(t, (t + {times('xor(t, t >> 7)', 't | 61')}) & {word}) as u from t) select xor(u, u >> 14) & {word} from u)"


@query("s_generator", f"select l_orderkey, l_linenumber, b as bits, b / 4294967296.0::double as number from (select l_orderkey, l_linenumber, {_drawn('(l_orderkey * 8 + l_linenumber)')} as b from lineitem) x")
def s_generator(spark, sf_dir):
    """A number of the seeded generator for each row, by the row's place alone."""
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", synthetic.random_bits(place).alias("bits"), synthetic.random_number(place).alias("number"))


@query("s_redrawn", f"""with k as (select o_orderkey, unnest(range(64)) as k from orders),
d as (select o_orderkey, k, lpad(cast({_drawn('(o_orderkey * 64 + k)')} % 1000000000 as varchar), 9, '0') as v from k),
s as (select *, ({" + ".join(f"cast(substr(v, {n}, 1) as bigint) * {w}" for n, w in enumerate((6, 5, 7, 2, 3, 4, 5, 6, 7), 1))}) % 11 as c from d)
select o_orderkey, arg_min(v || c, k) as nip, true as valid from s where c <> 10 group by o_orderkey""")
def s_redrawn(spark, sf_dir):
    """A valid number for each row, drawn again where the control digit would be 10."""
    from ..functions.checksums import weighted_column

    made = table(spark, sf_dir, "orders").select("o_orderkey", synthetic.nip(F.col("o_orderkey")).alias("nip"))
    return made.select("o_orderkey", "nip", weighted_column("nip", F.col("nip")).alias("valid"))


# Views

_LONG = views.MARK_LIMIT - 6
_MARKED = "c_custkey % 97 = 5"  # texts beyond the limit are long, so few of the rows have one


@query("x_marked", f"select c_custkey, case when {_MARKED} then '[PESEL]' || repeat('a', {_LONG}) else '<mark>[PESEL]</mark> &lt;' || c_custkey end as html from customer")
def x_marked(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"case when {_MARKED} then '[PESEL]' || repeat('a', {_LONG}) else '[PESEL] <' || c_custkey end as t")
    return df.select("c_custkey", views.marked_html(F.col("t")).alias("html"))


@query("x_types_of", "select o_orderkey, 'mail a' || o_orderkey || '@x.pl, PESEL [PESEL]' as redacted from (" + synthetic.VALUES["pesel"] + ") v")
def x_types_of(spark, sf_dir):
    """With one group of kinds on, only its kinds are masked."""
    made = synthetic.numbers(table(spark, sf_dir, "orders"), "o_orderkey", "pesel").selectExpr("o_orderkey", "'mail a' || o_orderkey || '@x.pl, PESEL ' || value as text")
    return redact(made, types=findings.types_of({g: g == "identity" for g in findings.GROUPS})).select("o_orderkey", "redacted")


@query("x_spans", "select o_orderkey, cast(0 as integer) as ord, '[PESEL]' as mask, cast(7 as integer) as start, cast(18 as integer) as \"end\", value as original from (" + synthetic.VALUES["pesel"] + ") v")
def x_spans(spark, sf_dir):
    made = synthetic.numbers(table(spark, sf_dir, "orders"), "o_orderkey", "pesel").select("o_orderkey", F.concat(F.lit("PESEL: "), "value", F.lit(" w aktach")).alias("text"))
    return masked_spans(made, "text", "o_orderkey", types=["PESEL"])


@query("t_missing_dim", "select event_type as dimension, count(*) as events, sum(value) as total from events where false group by 1")
def t_missing_dim(spark, sf_dir):
    return traffic.breakdown(table(spark, sf_dir, "events"), "no_such_column")


@query("t_of_host", "select count(*) as events, round(sum(value), 4) as total from events where event_type = 'click'")
def t_of_host(spark, sf_dir):
    only = traffic.only(table(spark, sf_dir, "events"), "event_type", "click")
    return traffic.summary(only).select("events", F.round("total", 4).alias("total"))


# Relations

_KEYS = "select c_nationkey as k from customer where c_acctbal > 0", "select s_nationkey as k from supplier where s_acctbal > 5000"


def _two(spark, sf_dir):
    left = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return left, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


@query("u_union", f"{_KEYS[0]} union {_KEYS[1]}")
def u_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.union(b).distinct()


@query("u_intersect", f"{_KEYS[0]} intersect {_KEYS[1]}")
def u_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query("u_except", f"{_KEYS[0]} except {_KEYS[1]}")
def u_except(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.exceptAll(b).join(b.distinct(), "k", "left_anti").distinct()


_BUYS = "(select o_orderkey, o_custkey as k, cast(o_orderdate as timestamp) as at from orders)"
_RATES = "(select o_custkey as k, cast(o_orderdate as timestamp) as at, max(o_totalprice) as price from orders where o_orderkey % 3 = 0 group by 1, 2)"


@query("u_as_of", f"select b.o_orderkey, b.k, r.price from {_BUYS} b asof left join {_RATES} r on b.k = r.k and b.at >= r.at")
def u_as_of(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("price"))
    rates = o.where("o_orderkey % 3 = 0").groupBy("k", "at").agg(F.max("price").alias("price"))
    return relations.as_of(o.select("o_orderkey", "k", "at"), rates, "k", "at", ["price"]).select("o_orderkey", "k", "price")


@query("u_rules", "select p_partkey, rule from part, (values ('metal', 'steel|brass|copper|nickel|tin'), ('early', '^[a-h]'), ('none', 'qqq')) r(rule, pattern) where regexp_matches(lower(p_name), pattern)")
def u_rules(spark, sf_dir):
    rules = {"metal": "steel|brass|copper|nickel|tin", "early": "^[a-h]", "none": "qqq"}
    return relations.matching(table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("t")), "t", rules).select("p_partkey", "rule")


@query("u_estimates", "select o_orderpriority, true as distinct_close, true as median_close from orders group by o_orderpriority")
def u_estimates(spark, sf_dir):
    """Estimates by group beside what they stand for: within a twentieth, and between the ranks beside the median."""
    orders = table(spark, sf_dir, "orders")
    about = relations.estimates(orders, "o_orderpriority", "o_custkey")
    ranks = F.percentile("o_custkey", F.array(F.lit(0.49), F.lit(0.51))).alias("around")
    exact = orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("exact"), ranks)
    near = F.abs(F.col("about_distinct") - F.col("exact")) <= 0.08 * F.col("exact")
    return about.join(exact, "o_orderpriority").select("o_orderpriority", near.alias("distinct_close"), F.col("about_median").between(F.col("around")[0], F.col("around")[1]).alias("median_close"))


@query("u_sql_text", "select o_orderpriority, count(*) as n from orders where o_orderkey % 2 = 0 group by 1")
def u_sql_text(spark, sf_dir):
    return spark.sql("select o_orderpriority, count(*) as n from {o} where o_orderkey % 2 = 0 group by 1", o=table(spark, sf_dir, "orders"))


@query("e_cases", recall.cases_sql("customer", "c_custkey", _drawn))
def e_cases(spark, sf_dir):
    """Labelled sentences, drawn for each customer's key."""
    only = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    made = recall.cases(table(spark, sf_dir, "customer"), "c_custkey")
    return made.select("id", "category", only("must_mask").alias("must_mask"), only("must_keep").alias("must_keep"), "text")


@query("e_recall")
def e_recall(spark, sf_dir):
    """What redaction finds of labelled sentences, by category."""
    return recall.measured(table(spark, sf_dir, "customer"), "c_custkey")
