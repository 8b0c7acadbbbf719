"""The corpus operators against brute force, and their defined results at the edges."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from zaslona.llm import common, decontaminate, licences, lines, mixing, pieces, quality, runs, simhash, substrings, topk, wrappers

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, blanks and one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(n)]
    shared = prose(rng, 60)
    rows = []
    for i, t in enumerate(base):
        rows.append(t if i % 4 else f"{t}\n{shared}\n{prose(rng, 12)}")
    rows += [base[3], base[3], base[5] + " tail", base[5].replace("w1", "w2", 1), None, "", " \n ", "Zażółć gęślą jaźń", "a", "aaaa" * 100, prose(rng, 4000)]
    return list(enumerate(rows))


CLASHING = "doc_id long, text string, id long, text_hash long, fp long, key string, n_lines string, score string, ids string, row int, spans int, low int, w int, items string, n_dropped int"


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with columns whose names the operators use themselves, repeated rows and a null id."""
    rows = [(i, t) for i, t in corpus()]
    rows += [rows[0], rows[0], (None, rows[1][1])]
    return spark.createDataFrame([(i, t, 7, 7, 7, "k", "n", "s", "i", 1, 2, 3, 4, "x", 5) for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# 1


def test_templates_share_a_key_by_quarter():
    a = "alpha beta " + " ".join(f"t{c}" for c in "abcdefgh")
    assert set(lines.templates(a)) & set(lines.templates(a.replace("tg th", "xx yy")))
    assert not set(lines.templates(a)) & set(lines.templates(a.replace("ta", "xx").replace("th", "yy")))
    assert not set(lines.templates(a)) & set(lines.templates(a.replace("beta", "gamma")))
    assert lines.templates("user 12 logged in") == lines.templates("user 99 logged in")
    assert lines.templates("two words") == [] and lines.templates("") == []
    assert lines.templates("12.5 30.1 44.9") != lines.templates("2019 7 0.3") and lines.templates("1 2 3") == lines.templates("1  2 3")
    assert not set(lines.templates("row 1 2 3 4 5 6 7 8")) & set(lines.templates("row 1 2 3 4 5 6 7 9"))


def test_line_dedup(docs, empty):
    rows = plain(docs)
    first: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else ():
            for k in lines.templates(line):
                first[k] = min(first.get(k, i), i)
    expected = Counter()
    for i, t in rows:
        if t is None:
            expected[i, None, 0, 0] += 1
            continue
        every = t.split("\n")
        kept = [x for x in every if i is None or all(first[k] >= i for k in lines.templates(x))]
        expected[i, "\n".join(kept), len(every), len(every) - len(kept)] += 1
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup(docs).collect())
    assert got == expected and any(k[3] for k in got)
    assert lines.dedup(empty).count() == 0


# 2

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=x>m</a></ul></nav>
<div class="ad-box">AD</div><article class=post><h1>T &amp; x</h1><p>a <b>b<br>c<p>d&nbsp;e<ul><li>one<li>two</ul><form>f<input></form><!-- c -->
<section class="comments"><p>bad</p></section><aside>n</aside><p>x < y</p></article><div id=cookieNotice>c</div><footer>f"""


def test_main_text():
    assert wrappers.main_text(wrappers.parse(PAGE)) == "T & x\na b c\nd e\none\ntwo\nx < y"
    assert wrappers.main_text(wrappers.parse(None)) == "" == wrappers.main_text(wrappers.parse("<p"))
    page = "<header>Site</header><div class='site-header'>x</div>{}<div class=sidebar>s</div>"
    for part in ("<article><div class=entry-header><h1>T</h1></div><p>a</p></article>", "<div id=content><header><h1>T</h1></header><p>a</p></div>", "<h1>T</h1><p>a</p>"):
        assert wrappers.main_text(wrappers.parse(page.format(part))) == "T\na"
    assert wrappers.main_text(wrappers.parse("<div>" * 5000 + "deep")) == "deep"
    assert wrappers.main_text(wrappers.parse("<article>" + "<div>" * 150 + "<nav>m</nav>x<nav><p>m</p></nav>" + "</div>" * 150 + "<p>y</p></article>z")) == "x\ny"
    assert wrappers.main_text(wrappers.parse("<table><tr><td>a<td>b<tr><td>c</table>")) == "a b\nc"
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    assert wrappers.main_text(wrappers.parse(long)) == ("word " * 200_000).strip()


def test_usual_words_in_names_stay():
    for part in ('<p class="promotion">a b</p>', '<div class="related-work">a b</div>', '<div id="search-results-study">a b</div>'):
        assert wrappers.main_text(wrappers.parse(f"<article><h1>Title</h1>{part}<p>end</p></article>")) == "Title\na b\nend"
    assert wrappers.main_text(wrappers.parse('<div class="layout has-sidebar"><article class="post category-social tag-search"><h2 id="search">S</h2><p>a</p></article></div>')) == "S\na"


def test_wrappers_generalise():
    pages = ["<ul><li>a</li><li>b</li></ul><p>same</p><p>x</p>", "<ul><li>c</li></ul><h2>t</h2><p>same</p>"]
    w = wrappers.merge(*(wrappers.wrapper(wrappers.parse(p)) for p in pages))
    assert wrappers.expression(w) == "<ul>(<li>#</>)+</>(<h2>=</>)?(<p>#</>)+"
    two = ["<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>", "<dl><dt>e</dt><dd>f</dd></dl>"]
    w = wrappers.merge(*(wrappers.wrapper(wrappers.parse(p)) for p in two))
    assert wrappers.expression(w).startswith("<dl>(<dt>#</><dd>#</>)?+")


def hosts_of_pages():
    """Sixty pages of five hosts by hand, with the text that each should give: rows (url, html, text)."""
    rng, rows = random.Random(12), []
    menu = lambda n: "".join(f"<li><a href=/{n}{k}>{n} item {k}</a></li>" for k in range(5))
    for i in range(12):
        body = [prose(rng, rng.randrange(12, 40), 3000) for _ in range(rng.randrange(2, 5))]
        title, blocks = f"Title {i} {prose(rng, 3, 3000)}", "".join(f"<p>{b}</p>" for b in body)
        text = "\n".join([title, *body])
        # An article tag; inside it a notice of the design, which always says the same, and an advert, which does not.
        rows.append((f"https://a.example/{i}", f"<body><nav><ul>{menu('a')}</ul></nav><article><h1>{title}</h1>{blocks}<div class=newsletter>Get our letter</div><div class='ad'>Buy {prose(rng, 3)}</div></article><footer>f</footer></body>", text))
        # No article tag and no telling names: the menu and the imprint are the design.
        rows.append((f"https://b.example/{i}", f"<body><div><ul>{menu('b')}</ul></div><div><h1>{title}</h1>{blocks}</div><div>Imprint and contact of b</div></body>", text))
        # A column of links beside the article, with other links on every page.
        rows.append((f"https://c.example/{i}", f"<table><tr><td class=col>{''.join(f'<a href=/{k}>{prose(rng, 2)}</a> ' for k in range(6))}</td></tr></table><div class=text><h1>{title}</h1>{blocks}</div>", text))
        # A word in a class that only one page has is no design.
        odd = "<p class=notice>An odd remark</p>" if i == 4 else ""
        rows.append((f"https://d.example/{i}", f"<main><h1>{title}</h1>{blocks}{odd}<p>License: MIT</p></main><div id=comments><p>{prose(rng, 4)}</p></div>", text + ("\nAn odd remark" if odd else "") + "\nLicense: MIT"))
        # A host that has one page only, again and again, has no design to tell.
        rows.append(("https://e.example/", "<body><h1>Only</h1><p>one page</p></body>", "Only\none page"))
    return rows


def test_wrappers_decide(spark):
    rows = hosts_of_pages()
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string, text string").repartition(7)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert [got[i] for i in range(len(rows))] == [t for _, _, t in rows]
    without = [wrappers.main_text(wrappers.parse(h)) for _, h, _ in rows]
    assert sum(a != t for a, (_, _, t) in zip(without, rows)) >= 24  # the wrapper decides


def test_extraction(spark):
    frame = lambda t: f"<body><div>Imprint</div><div><p>{t}</p></div></body>"
    rows = [(i, f"https://a.example/{i}", frame(f"text {i}"), "t") for i in range(5)] + [(9, None, None, "t"), (9, None, None, "t"), (10, "http://b", PAGE, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = wrappers.extract(df).collect()
    assert len(got) == 8 and {r["page_id"]: r["text"] for r in got if r["page_id"] < 9} == {i: f"text {i}" for i in range(5)}
    assert [r["text"] for r in got if r["page_id"] == 9] == ["", ""]
    assert wrappers.extract(df.limit(0)).count() == 0
    assert [wrappers.host(u) for u in ("https://u@A.b:8/x", "//c/d", "e", None)] == ["a.b", "c", "", ""]


def _articles(spark, inner, n=5):
    """n pages of one host with an article that holds the part, extracted together, and each on its own."""
    rows = [(i, f"http://one.example/{i}", f"<html><body><article><h1>Title {i}</h1><p>First words of page {i * 37}.</p>{inner.format(i=i)}<p>Last words {i * 91}.</p></article></body></html>") for i in range(n)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in out}, {i: wrappers.main_text(wrappers.parse(h)) for i, _, h in rows}


@pytest.mark.parametrize("name", ["discussion", "related", "notice", "tags"])
def test_changing_parts_of_an_article_stay(spark, name):
    """Whatever a part is called, an article's own changing text is its text."""
    found, alone = _articles(spark, f'<section class="{name}"><h2>Discussion</h2><p>our result {{i}} differs</p></section>')
    assert all(t == f"Title {i}\nFirst words of page {i * 37}.\nDiscussion\nour result {i} differs\nLast words {i * 91}." for i, t in found.items())
    assert found == alone


@pytest.mark.parametrize("inner", ['<div class="notice">All rights of this text are reserved.</div>', '<div class="related">See <a href="/x">one long linked title here</a> <a href="/y">another {i}</a></div>'])
def test_the_wrapper_tells_the_designs_parts_of_an_article(spark, inner):
    found, alone = _articles(spark, inner)
    assert all(t == f"Title {i}\nFirst words of page {i * 37}.\nLast words {i * 91}." for i, t in found.items())
    if "rights" in inner:
        assert all("All rights" in t for t in alone.values())  # a page by itself does not show it


@pytest.mark.parametrize("name", ["comments", "ad", "sidebar"])
def test_sure_names_go_on_any_page(spark, name):
    found, alone = _articles(spark, f'<div class="{name}"><p>somebody wrote {{i}}</p></div>')
    assert found == alone and all("somebody" not in t for t in found.values())


# 3


def slow_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, linked):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def components_of(rows, fps, radius):
    r = roots(fps, lambda a, b: (a ^ b).bit_count() <= radius)
    low: dict = {}
    for (i, _), c in zip(rows, r):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return Counter((i, f, low.get(c)) for (i, _), f, c in zip(rows, fps, r))


@pytest.mark.parametrize("run_max", [1 << 20, 2])
def test_simhash_groups(docs, run_max):
    rows = plain(docs)
    fps = [slow_fingerprint(t, 4) for _, t in rows]
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(docs, run_max=run_max).collect())
    assert got == components_of(rows, fps, 4)


@pytest.mark.parametrize("run_max", [1 << 20, 3])
def test_ball_hashing_loses_no_link(spark, run_max):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    stash = common.Stash(spark)
    e = simhash.edges(spark.createDataFrame([(f,) for f in fps], "fp long"), stash, 4, run_max)
    c = {r["u"]: r["root"] for r in common.components(e, stash).collect()}
    want = roots([f % (1 << 64) for f in fps], lambda a, b: (a ^ b).bit_count() <= 4)
    got = [c.get(f, f) for f in fps]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


@pytest.mark.parametrize("run_max", [1 << 20, 2])
def test_near_duplicates(spark, run_max):
    rng = random.Random(4)
    texts = [prose(rng, 200, 5000) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts[:10])]
    rows += [(200 + i, " ".join(t.split()[:-2])) for i, t in enumerate(texts[:20])] + [(300, None), (301, ""), (None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.similar(df, run_max=run_max).collect())
    want = Counter((i, 300 if not t else next(j for j, x in enumerate(texts) if x.startswith(t))) for i, t in rows)
    assert got == want


@pytest.mark.parametrize("run_max", [1 << 20, 2])
def test_near_duplicates_are_all_of_similarity_08(spark, run_max):
    rng = random.Random(8)
    texts = []
    for n in (12, 40, 150, 300):
        for _ in range(5):
            words = prose(rng, n, 5000).split()
            texts.append(" ".join(words))
            for share in (0.02, 0.03, 0.04, 0.05, 0.06):
                away = set(rng.sample(range(n), max(1, round(share * n))))
                texts.append(" ".join(f"new{rng.randrange(10**6)}" if i in away else w for i, w in enumerate(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    close = lambda a, b: len(a & b) / len(a | b)
    values = [close(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.75 <= x < 0.8 for x in values) > 5 < sum(0.8 <= x <= 0.85 for x in values)
    want = roots(sets, lambda a, b: close(a, b) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, run_max=run_max).collect()}
    assert [got[i] for i in range(len(texts))] == [min(j for j, y in enumerate(want) if y == x) for x in want]


def test_fingerprints_of_like_sets_are_close():
    rng = np.random.default_rng(15)
    for n in (6, 20, 100, 1000):
        for _ in range(60):
            both = rng.integers(0, 1 << 63, n).astype(np.uint64)
            keep = int(np.ceil(0.8 * n))  # a part of a set, or two parts that share four fifths of all
            cut = n - (n - keep) // 2
            a, b = (both[:keep], both) if rng.random() < 0.5 else (both[:cut], both[cut - keep :])
            assert len(np.intersect1d(a, b)) >= 0.59 * n
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                x, y = (np.frombuffer(simhash.wide(s), np.uint64) for s in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= simhash.APART
    other = [np.frombuffer(simhash.wide(rng.integers(0, 1 << 63, 300).astype(np.uint64)), np.uint64) for _ in range(40)]
    assert simhash.kin(np.stack(other), np.full(40, 300)) == []
    assert len(simhash.kin(np.stack([other[0]] * 5), np.array([100, 100, 100, 100, 126]))) == 3
    s = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    assert np.array_equal(simhash.unpacked(simhash.packed(s)), s >> np.uint64(24))


def test_simhash_empty(empty):
    assert simhash.groups(empty).count() == 0
    assert simhash.similar(empty).count() == 0


# 4


def slow_hits(text, items, size=13):
    w = WORD.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").translate(FOLD))
        n = min(size, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    items_ = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(items_.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination(spark, docs, empty, bound):
    texts = [t for _, t in corpus() if t and len(t) > 300]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    items = [(1, cut(texts[0], 3, 40)), (2, cut(texts[1], 5, 15).upper()), (10, "w1"), (3, None), (4, " .. "), (5, "never seen words here"), (1, cut(texts[2], 0, 13)), (None, cut(texts[3], 0, 14)), (6, cut(texts[0], 3, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.report(docs, bench, broadcast_bytes=bound).collect())
    assert got == Counter((i, *slow_hits(t, items)) for i, t in plain(docs))
    assert decontaminate.report(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.report(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_is_native(spark, docs):
    plan = decontaminate.report(docs, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# 5


def test_quality_learns_and_covers_edges(spark, empty):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.5 else f"word{rng.randrange(300)}" for _ in range(80))
    bad = lambda: " ".join(f"word{rng.randrange(300)}%%%" for _ in range(80))
    rows = [(i, (good if i % 2 else bad)(), "x") for i in range(600)] + [(None, None, "x"), (601, "", "x"), (602, "a", "x"), (602, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.with_score(df, labels, columns=["doc_id"]).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(600), 601, 602] if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = sum((r["score"] >= 0.3) != bool(r["doc_id"] % 2) for r in held if r["doc_id"] < 600)
    assert wrong <= 0.03 * len(held)
    assert quality.with_score(empty, labels).count() == 0
    assert {r["score"] for r in quality.with_score(df, labels.limit(0)).collect()} == {0.5}


def test_features_by_brute_force():
    rng = random.Random(16)
    table = np.random.default_rng(16).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = [prose(rng, n, 50) for n in (1, 2, 40, 5000)] + ["", None]
    for t, ids in zip(texts, quality.tokens(texts)):
        v, n = table[ids].astype(float), max(1, len(ids))
        want = [v.sum(axis=0) / n, (v * v).sum(axis=0) / n, (v[:-1] * v[1:]).sum(axis=0) / n]
        assert np.allclose(quality.pooled(ids, table), np.concatenate(want), atol=1e-4)


def test_hashes_do_not_depend_on_company():
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(0, 50)).encode() for _ in range(30)] + [b"", b"x" * 3000, b"a b"]
    kind = runs.classes(words=bytes(set(range(256)) - set(b" \n")))
    together, alone = runs.hashes(texts, kind), [runs.hashes([t], kind)[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
    assert [len(x) for x in alone] == [len(t.split()) for t in texts]
    names: dict = {}
    for t, h in zip(texts, alone):
        for w, x in zip(t.split(), h):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    long = b" ".join([b"word%d" % i for i in range(300_000)])
    assert len(runs.hashes([long], kind)[0]) == 300_000
    huge = b"y" * (10 * runs.BLOCK)
    assert [len(x) for x in runs.hashes([huge + b" a " + huge, b"a"], kind)] == [3, 1]


# 6


def slow_removal(rows):
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_repeated_strings(docs, empty, monkeypatch, block):
    monkeypatch.setattr(substrings, "_ROWS", block)
    got = Counter(tuple(r) for r in substrings.report(docs).collect())
    assert got == slow_removal(plain(docs)) and any(k[2] for k in got)
    assert substrings.report(empty).count() == 0


def test_anchors_are_local():
    rng = random.Random(8)
    raw = bytes(rng.randrange(97, 101) for _ in range(5000))
    at, rank = substrings.anchors(raw)
    part, _ = substrings.anchors(raw[1000:1050])
    assert set((part + 1000).tolist()) <= set(at.tolist())
    old, substrings._PIECE = substrings._PIECE, 700
    try:
        again = substrings.anchors(raw)
    finally:
        substrings._PIECE = old
    assert np.array_equal(at, again[0]) and np.array_equal(rank, again[1])


# 7


@pytest.mark.parametrize("frequent", [50_000, 10])
def test_language_model(docs, empty, frequent):
    rows = plain(docs)
    token = lambda t: (t or "").encode().lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c: Counter = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*token(t), None])
    n, v = sum(c.values()), len(c)
    expected = sorted((i is None, i or 0, len(token(t)) + 1, sum(c[x] > 0 for x in [*token(t), None]), n, held(i), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*token(t), None]), 4)) for i, t in rows)
    got = mixing.score(docs, frequent=frequent).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert mixing.score(empty).count() == 0


def test_codes_are_distributions():
    for c in (mixing.code(), mixing.Code([5.0, 1.0, 1.0, 9.0, 2.0])):
        assert abs(sum(2.0 ** -int(x) for x in c.length) - 1) < 1e-12
        owner, place = c.bits(np.arange(len(c.length)))
        assert len({tuple(zip(c.node[place[owner == k]].tolist(), c.bit[place[owner == k]].tolist())) for k in range(len(c.length))}) == len(c.length)
    assert mixing.units(b"a b\n") == [b"a ", b"b\n", b""] and mixing.units(b"") == [b""] and mixing.units(b"x") == [b"x"]
    assert b"".join(mixing.units(b" q  w ")) == b" q  w "


def path_model(texts):
    count = Counter(u for t in texts for u in mixing.units(t))
    top = [u for u, _ in count.most_common(300)]
    path = mixing.Path(top, [count[u] for u in top], 5)
    batch = pa.record_batch([pa.array([t.decode() for t in texts])], names=["t"])
    rows = [r for b in mixing.paired(path)(iter([batch])) for r in b.column(2).to_pylist()]
    pairs = np.concatenate([mixing._counts(r) for r in rows])
    assert pairs.sum() == sum(count.values())
    return mixing.PathModel(path, pairs.astype(np.uint32))


def read(model, raws):
    reader = mixing.Reader({}, model, mixing.Model(mixing.spelling(np.zeros(2 * sum(mixing.SLOTS), np.uint32))))
    return [(float(r[5].sum()), r[4].tolist()) for r in reader.read(raws)]


def test_units_are_cut_alike():
    rng = random.Random(6)
    raws = ["".join(rng.choice("ab \n\t é") for _ in range(rng.randrange(0, 60))).encode() for _ in range(200)] + [b"", b" ", b"a", b"a "]
    for group in mixing.pieces(raws):
        cut = mixing.Cut(group)
        every = [u for _, raw, _ in group for u in mixing.units(raw)]
        assert [cut.unit(i) for i in range(len(cut.end))] == every and cut.count.tolist() == [len(mixing.units(raw)) for _, raw, _ in group]
        names = {}
        assert all(names.setdefault(u, h) == h for u, h in zip(every, cut.hash.tolist())) and len(set(names.values())) == len(names)
        assert np.array_equal(mixing.unit_hashes(every), cut.hash)


def test_paths_are_a_distribution_after_any_context():
    rng = random.Random(7)
    model = path_model([prose(rng, 200, 30).encode() for _ in range(20)])
    assert np.allclose(np.exp(model.log.astype(float)).sum(axis=2), 1, atol=1e-4)


def test_a_text_costs_the_same_in_any_company(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, n, 60).encode() for n in (3, 700, 90, 0, 2500)] + [b"a\nb\n\nc", b""]
    model = path_model(texts)
    alone = [read(model, [t])[0] for t in texts]
    together = read(model, texts)
    assert [k for _, k in together] == [k for _, k in alone] and np.allclose([x for x, _ in together], [x for x, _ in alone], rtol=1e-5)
    monkeypatch.setattr(mixing, "TOGETHER", 512)  # long texts in parts: weights step at other places, all else is the same
    parts = read(model, texts)
    assert np.allclose([x for x, _ in parts], [x for x, _ in alone], rtol=0.02) and [len(k) for _, k in parts] == [len(k) for _, k in alone]


def test_word_order_is_learnt(spark):
    rng = random.Random(13)
    after = {w: [rng.randrange(200) for _ in range(4)] for w in range(200)}

    def text(n):
        w, out = rng.randrange(200), []
        for _ in range(n):
            out.append(f"word{w}")
            w = rng.choice(after[w])
        return " ".join(out)

    rows = [(i, text(rng.randrange(30, 300))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    got = mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    score, base = (sum(r[c] for r in held) for c in ("score", "base_score"))
    assert len(held) > 20 and score > 0.5 * base  # the order of words saves most of a word's cost
    one = {r["doc_id"]: r for r in got}
    twice = [one[i] for i in range(40) if not one[i]["held_out"] and not one[1000 + i]["held_out"]]
    once = [r for i, r in one.items() if 40 <= i < 1000 and not r["held_out"]]
    # Texts that occur twice are told from those that occur once.
    assert twice and max(r["bits_per_byte"] for r in twice) < min(r["bits_per_byte"] for r in once)


# 8


def test_licenses(spark, empty):
    notice = licences.TEMPLATES[7][1]
    mit = licences.TEMPLATES[12][1]
    texts = ["x y " + notice + " z", mit.upper(), mit.replace("software", "program"), "cc by cc by, MIT License", None, "", "permission is hereby", "ccby", notice + "\n" + mit]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, texts[3], "k"), (3, texts[3], "k")]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert len(licences.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()) == len(rows)
    assert got[0]["labels"] == "gpl" and got[0]["n_base"] == 1 and got[0]["score"] == 1.0
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["score"] == 1.0
    assert got[2]["labels"] == "mit" and 0.6 <= got[2]["score"] < 1
    assert (got[3]["base_labels"], got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == ("cc-by,mit", 3, 0, 4)
    assert (got[4]["n_words"], got[4]["score"], got[4]["first_word"], got[4]["labels"]) == (0, 0.0, None, "")
    assert got[6]["labels"] == got[7]["labels"] == "" and got[8]["labels"] == "gpl,mit"
    assert got[None]["base_labels"] == "cc-by,mit"
    assert licences.scan(empty).count() == 0


def test_licenses_are_named(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = {
        "Released under the Apache License": "apache",
        "a film released under the title of the book": "",
        "so it was Released under the MIT License. And more": "mit",
        cc.format(""): "cc-by",
        cc.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        cc.format("-ShareAlike"): "cc-by-sa",
        cc.format("-NonCommercial"): "cc-by-nc",
        "Licensed under CC BY-NC-ND 4.0.": "cc-by,cc-by-nc-nd",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
    }
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["labels"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == list(texts.values())


def slow_base(text):
    w = WORD.findall((text or "").translate(FOLD))
    places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_labels_by_brute_force(spark, docs):
    rng = random.Random(14)
    some = ["GNU", "General", "public", "license", "Apache", "License,", "CC", "BY.", "MIT", "-", "é", "mit2", "gnu-general", "\n"]
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(0, 80)))) for i in range(120)]
    rows += [(500, " ".join(rng.choice(some) for _ in range(300_000))), (501, "x" * 3_000_000 + " mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licences.scan(df).collect())
    assert got == Counter((i, *slow_base(t)) for i, t in plain(df))


# 9


def in_chunks(p, text, size):
    """The ids of a text by its chunks' matrices."""
    m = pieces.marked(text)
    chunks = [(m[max(0, k - p.width) : k], m[k : k + size], m[k + size : k + size + p.width]) for k in range(0, len(m), size)]
    matrices = [p.matrix(*c) for c in chunks]
    assert pieces.product(matrices).max() == 0
    states = pieces.scan(matrices)
    return [y for c, a, b in zip(chunks, states, states[1:]) for y in p.between(*c, a, b)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    p, rng = pieces.pieces(), random.Random(9)
    texts = ["".join(rng.choice("aeinrst  thé你\n0ç.,ABCing(){}=_-") for _ in range(rng.randrange(1, 140))) for _ in range(300)]
    texts += ["hello world", "Zażółć gęślą jaźń", "  two  ", " ", "\t\r\n", "x" * 500, "aeinrst" * 40]
    assert [x.tolist() for x in p.encode_all(texts)] == lib.encode(texts)
    read = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and not contains(text, '\u2581')").limit(200)
    rows = pieces.with_ids(read.select("text"), chunk=700).collect()
    assert len(rows) == 200 and all(r["ids"] == lib.encode(r["text"]) for r in rows)


def test_pieces_do_not_depend_on_chunks():
    p, rng = pieces.pieces(), random.Random(9)
    for r in range(60):
        t = "".join(rng.choice("aeinrst  thé你▁\n0ç" if r % 2 else "aeinrst") for _ in range(rng.randrange(1, 120)))
        ids = p.encode(t)
        assert p.decode(ids) == t
        assert all(in_chunks(p, t, size) == ids for size in (1, 5, 16, 23, 40))


def test_pieces_round_trip(spark, docs, empty, monkeypatch):
    want = {r["text"]: r["ids"] for r in pieces.with_ids(docs).collect()}
    monkeypatch.setattr(pieces, "SEGMENT", 4)
    for out in (pieces.with_ids(docs), pieces.with_ids(docs, chunk=100)):
        rows = out.select("doc_id", "text", "ids", pieces.decoder()(F.col("ids")).alias("back")).collect()
        assert len(rows) == docs.count() and all(r["back"] == r["text"] and r["ids"] == want[r["text"]] for r in rows)
        assert [r["ids"] for r in rows if r["text"] is None] == [None] and want[""] == []
    checked = pieces.with_ids(docs.drop("text").withColumn("round_trip", F.lit(1)).join(docs.select("doc_id", "text").distinct(), "doc_id"), chunk=300, keep=["doc_id", "round_trip"], check=True)
    assert checked.columns == ["doc_id", "ids", "round_trip"] and {r["round_trip"] for r in checked.collect()} == {True}
    assert pieces.with_ids(empty).count() == 0


def test_products_are_associative():
    rng = np.random.default_rng(9)
    m = [np.where(rng.random((5, 5)) < 0.4, -np.inf, rng.integers(-9, 9, (5, 5))).astype(np.float32) for _ in range(9)]
    one = m[0]
    for x in m[1:]:
        one = pieces.times(one, x)
    assert np.array_equal(pieces.product(m), one)
    assert np.array_equal(pieces.product([pieces.product(m[:4]), pieces.product(m[4:])]), one)


# 10


@pytest.mark.parametrize("shard", [8192, 16])
def test_exact_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 32)
    rng = random.Random(10)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)] if i % 7 else [0.5] * 8) for i in range(150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (220, [0.25] * 3), (None, [1.0] * 8), (240, []), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:20]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want
    assert topk.top_k(df.limit(0)).count() == 0


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus(11, 40)]
    item = prose(rng, 30, 5000)
    rows += [(500, item + " " + prose(rng, 20), "en", "s", 0), (501, None, None, None, None), (501, None, None, None, None), (None, "lonely words in a row", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(cp.STAGES) <= 5
    for i, (name, stage) in enumerate(cp.STAGES):
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS
        if name in ("quality classifier", "line dedup", "SentencePiece encoding"):
            assert docs.count() == before  # no labels reject, lines never drop documents
    ids = [r["doc_id"] for r in docs.collect()]
    assert 500 not in ids and len(ids) == len(set(ids)) and {0, 1} <= set(ids)
    assert cp.run(spark, str(tmp_path)).count() == len(ids)


def test_pipeline_groups_by_fingerprints_and_by_similarity(spark, tmp_path):
    """A text that fingerprints link at a similarity below 0.8, and one that only similarity links, chain into one group."""
    import corpus_pipeline as cp

    near = lambda a, b: bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") <= 4
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    like = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b)) >= 0.8
    rng = random.Random(25)
    once, other, often = prose(rng, 120, 5000), prose(rng, 120, 5000), " ".join(["again"] * 600)
    by_print = [f"{often} {once}", f"{often} {other}"]  # one shingle repeats, so that sets say little of it
    by_set = by_print[0] + " other words stand here now" * 400
    assert near(*by_print) and not like(*by_print) and like(by_print[0], by_set) and not near(by_print[0], by_set) and not near(by_print[1], by_set)
    assert not like(by_print[1], by_set)
    rows = [(1, by_print[1]), (2, by_print[0]), (3, by_set), (4, prose(rng, 50, 5000)), (4, by_set), (5, None), (6, " "), (None, by_set), (None, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in cp.keep_first_of_group(spark, docs, str(tmp_path)).collect() if r["text"]) == [(0, "a text of its own"), (1, by_print[1]), (4, rows[3][1])]


def test_tables_of_rounds_that_are_over_go(spark):
    """What the last table of repeated strings was made from leaves the disk, and so do the tables between the rounds."""
    import os

    from zaslona.llm import common, substrings

    shared = "".join(chr(97 + i * 7 % 26) for i in range(80))
    docs = spark.createDataFrame([(i, f"{i} begins {shared} ends {i * i}") for i in range(40)], "doc_id long, text string")
    before = set(os.listdir(common.shared_dir(spark)))
    found, _ = substrings.spots(docs)
    (root,) = set(os.listdir(common.shared_dir(spark))) - before
    assert found.count() == 39
    assert len(os.listdir(f"{common.shared_dir(spark)}/{root}")) == 2  # found itself and the texts' smallest ids
