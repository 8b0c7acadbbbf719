"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, licences, lines, mixing, phrases, pieces, quality, resample, simhash, substrings, token_files, topk, wrappers
from .common import table


def op1_line_dedup(spark, sf_dir):
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_html_extraction(spark, sf_dir):
    out = wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_simhash_near_dedup(spark, sf_dir):
    g = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, table(spark, sf_dir, "labels"), columns=["doc_id"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_suffix_array_dedup(spark, sf_dir):
    return substrings.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_model_score(spark, sf_dir):
    return mixing.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op9_sentencepiece(spark, sf_dir):
    out = pieces.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], check=True)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


def op10_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_importance_resampling(spark, sf_dir):
    return resample.draw(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_phrase_mining(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


_OPERATORS = (
    op1_line_dedup,
    op2_html_extraction,
    op3_simhash_near_dedup,
    op4_benchmark_decontamination,
    op5_quality_classifier,
    op6_suffix_array_dedup,
    op7_language_model_score,
    op8_license_scan,
    op9_sentencepiece,
    op10_exact_top_k,
    op11_token_files,
    op12_importance_resampling,
    op13_phrase_mining,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

SQL: dict[str, str] = {}

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_benchmark_decontamination"] = f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({_FOLD}, {_WORDS}) as w from documents),
b as (select item_id, regexp_extract_all({_FOLD}, {_WORDS}) as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as t
        from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
place as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as t
          from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select p.r, p.i, p.n, win.item_id from place p join win on p.n = win.n and p.t = win.t),
pos as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + n)) as x from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hit) group by r)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (r) left join its using (r)
"""

SQL["op10_exact_top_k"] = """
with v as (select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from v),
s as (select q.vec_id as query_id, e.vec_id, cast(sum(q.x * e.x) as bigint) as score
      from e as q join e on q.i = e.i where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

# crc32 by a table of 256 remainders, made by rule; bytes are read from the text's hexadecimal form.
SQL["op12_importance_resampling"] = f"""
with recursive bits as (select i as b, i as c, 0 as k from range(256) t(i)
  union all select b, xor(c >> 1, 3988292384 * (c & 1)), k + 1 from bits where k < 8),
tab as (select list(c order by b) as t from bits where k = 8),
d as (select row_number() over () as row_no, doc_id, regexp_extract_all({_FOLD}, {_WORDS}) as w from documents),
b as (select regexp_extract_all({_FOLD}, {_WORDS}) as w from benchmark),
df as (select row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
bf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
dn as (select f, count(*) as n from df group by f), bn as (select f, count(*) as n from bf group by f),
feats as (select f, hex(encode(f)) as h from (select f from dn union select f from bn)),
coded as (select f, list_transform(range(1, len(h), 2), lambda i: cast('0x' || h[i : i + 1] as bigint)) as x from feats),
crcs as (select f, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), cast(4294967295 as bigint)), 4294967295) % 10000 as bucket from coded, tab),
s as (select bucket, sum(n) as s from dn join crcs using (f) group by bucket),
t as (select bucket, sum(n) as t from bn join crcs using (f) group by bucket),
tot as (select (select coalesce(sum(s), 0) from s) as s_all, (select coalesce(sum(t), 0) from t) as t_all),
gains as (select i as bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((coalesce(s, 0) + 1)::double * (t_all + 10000)::double))) as bigint) as g
  from range(10000) r(i) left join s on s.bucket = i left join t on t.bucket = i, tot),
w as (select row_no, count(*) as n_features, cast(floor(cast(sum(g) as double) / count(*)) as bigint) as weight from df join crcs using (f) join gains using (bucket) group by row_no),
h as (select row_no, doc_id, len(w) as n_words, cast('0x' || sha256('7:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) as h from d),
sc as (select row_no, h.doc_id, n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from h left join w using (row_no)),
r as (select row_no, row_number() over (order by score desc, doc_id) as rank from sc where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * (select count(*) from r) // 100 then rank end as rank from sc left join r using (row_no)
"""

SQL["op13_phrase_mining"] = """
with d as (select row_number() over () as row_no, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
tot as (select lang, cast(sum(len(w)) as hugeint) as n from p group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) as g from p, range(1, 6) t(k) where len(w) >= k),
f as (select lang, k, g, cast(count(*) as hugeint) as a from g group by lang, k, g having count(*) >= 100),
cut as (select c.lang, c.k, c.g, c.a, j, l.a as l, r.a as r, n, 1000 * c.a * n // (l.a * r.a) as score
  from f as c, range(1, 5) t(j), f as l, f as r, tot where c.k >= 2 and j < c.k and l.lang = c.lang and l.k = j and l.g = c.g[1 : j] and r.lang = c.lang and r.k = c.k - j and r.g = c.g[j + 1 :] and tot.lang = c.lang),
best as (select *, row_number() over (partition by lang, g order by score, j) as o from cut),
sub as (select distinct lang, unnest(list_transform(range(1, k - m + 2), lambda i: g[i : i + m - 1])) as g, a as above from f, range(2, 5) t(m) where m < k),
gone as (select f.lang, f.g from f join sub using (lang, g) where 100 * above >= 100 * f.a),
ok as (select lang, array_to_string(g, ' ') as phrase, a, l, r, n, score from best where o = 1 and not exists (select 1 from gone where gone.lang = best.lang and gone.g = best.g)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ok)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000
"""
