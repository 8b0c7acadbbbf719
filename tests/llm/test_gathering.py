"""Token files, importance resampling and phrase mining against brute force and the library."""

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

from pyspark.sql import functions as F

from zaslona.llm import common, phrases, resample, token_files

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CLASHING = "doc_id long, text string, lang string, word string, f long, part int, before long, ids string, score string, rank int, at int, n long, h long, place long, id long"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def prose(rng, n, words=60):
    return " ".join(f"{'W' if rng.random() < 0.1 else 'w'}{min(rng.randrange(words), rng.randrange(words))}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 160)), ("en", "fr", None)[i % 3]) for i in range(80)]
    odd = ["", None, " \n ", "New  York, new york. New\tYork!", "a.b,c;d:e!f?g", "a\x0bb\x0cc\rd\ne", "naïve Straße ŁÓDŹ 東京 東京", "x" * 5000, "a b a   b", "\x1c \x1f a", " lead and trail ", "<|endoftext|> is text", "don't we'll I'd 12 34 -- ?!"]
    rows += [(100 + i, t, "en") for i, t in enumerate(odd)]
    rows += [rows[4], rows[4], rows[5], (None, rows[6][1], "en"), (None, None, None), (200, " ".join(["new york"] * 70 + ["by the sea"] * 30), "de")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "w", 1, 2, 3, "i", "s", 4, 5, 6, 7, 8, 9) for i, t, lang in corpus()], CLASHING).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


# 11


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encoded(own, texts):
    ids, sizes = own.encode(pa.array(texts, pa.string()))
    return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_units_give_the_librarys_ids(library):
    rng = random.Random(2)
    signs = ["a", "the", "Ab", "é", "東", " ", " ", "  ", "\n", "\t", " ", " ", "᠎", "\x1c", "'s", "'ll", "12", "½", "-", "?!", "<|endoftext|>", "🙂", "́", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + [t or "" for _, t, _ in corpus()]
    own = token_files.Encoder(public.path("byte_bpe_50k.json"))
    for _ in range(2):  # the second time from memory
        for i in range(0, len(texts), 100):
            some = texts[i : i + 100]
            want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
            assert encoded(own, some) == want


def test_memory_of_units_is_bounded(monkeypatch, library):
    monkeypatch.setattr(token_files, "REMEMBERED", 10)
    own = token_files.Encoder(public.path("byte_bpe_50k.json"))
    for i in range(30):
        text = f"first {i} then {i * 7} {'long' * 40}"
        assert encoded(own, [text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(own.known) <= 10 >= len(own.older) and "long" * 40 not in own.known


def _expected(rows, library):
    out, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t, _ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_library_gets_bounded_stretches():
    """Many new words and many long stretches at once: ids as of whole texts, no call of the library with all of them."""
    import pyarrow as pa

    enc, given = token_files.Encoder(public.path("byte_bpe_50k.json")), []
    library = enc.library

    class Noting:
        def encode_batch_fast(self, texts, **options):
            given.append(sum(map(len, texts)))
            return library.encode_batch_fast(texts, **options)

    enc.library = Noting()
    texts = [" ".join(f"słowo{i * 7919 + j}x\n" if j % 5 == 0 else f"a{i}b{j}" for j in range(300)) for i in range(500)] + ["\t  \n" * 50 + f"z{i}" for i in range(3000)] + ["", "é" * 300_000]
    ids, sizes = enc.encode(pa.array(texts), 0)
    whole = [x for e in library.encode_batch(texts, add_special_tokens=False) for x in [*e.ids, 0]]
    assert ids.tolist() == whole and sizes.sum() == len(whole) and len(sizes) == len(texts)
    assert max(given) < 300_000 + (1 << 18) and sum(given) > 3 * (1 << 18)


def test_token_files_hold_every_document(docs, library):
    got = [tuple(r) for r in token_files.digest(docs, public.path("byte_bpe_50k.json")).collect()]
    want = _expected(corpus(), library)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    plain = [r for r in want if r[0] is not None]
    assert sorted((r for r in got if r[0] is not None), key=key) == plain  # equal ids have equal texts here
    assert sorted((r[2], r[3]) for r in got if r[0] is None) == sorted((r[2], r[3]) for r in want if r[0] is None)
    assert {r[1] for r in got} == {r[1] for r in want} or sum(r[2] for r in got) == sum(r[2] for r in want)


def test_token_files_of_nothing(empty):
    assert token_files.digest(empty, public.path("byte_bpe_50k.json")).collect() == []


def test_token_files_are_pruned_by_index_and_bloom_filter(spark, tmp_path, library):
    rows = [(3 * i, f"text number {i} " * (1 + i % 4)) for i in range(60_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).createOrReplaceTempView("pruned")
    path = str(tmp_path / "files")
    token_files.write(spark.table("pruned"), path, public.path("byte_bpe_50k.json"), stripe_bytes=64 << 10)
    found = token_files.read(spark, path, [3 * 4321, 5])
    assert "doc_id" in found._jdf.queryExecution().toString().split("PushedFilters")[1]
    assert [(r["doc_id"], r["ids"][:-1]) for r in found.collect()] == [(3 * 4321, library.encode(rows[4321][1], add_special_tokens=False).ids)]
    # The files' own metadata: several stripes, an index entry a thousand rows, Bloom filters on the id.
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(p for p in (tmp_path / "files" / "ids").iterdir() if p.suffix == ".orc" and p.stat().st_size > 1000)
    stripes = filters = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.STRIDE
        stripes += reader.getStripes().size()
        filters += any("BLOOM_FILTER" in str(s.getKind()) for stripe in reader.getStripes() for s in reader.rows().readStripeFooter(stripe).getStreamsList())
    assert stripes > len(files) > 1 and filters == len(files)


def test_a_stretch_of_ids(spark, tmp_path, library):
    rows = [(i, f"text {i * 17} " * (1 + i % 9)) for i in range(300)]
    path = str(tmp_path / "files")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, public.path("byte_bpe_50k.json"), part_bytes=1 << 10)
    flat = [x for _, t in rows for x in [*library.encode(t, add_special_tokens=False).ids, 0]]
    assert token_files.parts(spark, path).count() > 3
    for first, last in ((0, 10), (500, 1900), (len(flat) - 7, len(flat) + 50), (len(flat), len(flat) + 5), (30, 31)):
        got = sorted(token_files.stretch(spark, path, first, last).collect(), key=lambda r: r["start"])
        assert [x for r in got for x in r["ids"]] == flat[first:last]
        assert not got or got[0]["start"] == first


# 12


def _grams(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def _draw(rows, target, percent=25, min_words=20, max_n=2, m=10_000, seed=7):
    code = lambda f: zlib.crc32(f.encode()) % m
    source, wanted = Counter(), Counter()
    for _, t, *_ in rows:
        source.update(map(code, _grams(t, max_n)[1]))
    for t in target:
        wanted.update(map(code, _grams(t, max_n)[1]))
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + m) / ((source[b] + 1) * (t + m)))) for b in range(m)]
    out = []
    for i, text, *_ in rows:
        words, grams = _grams(text, max_n)
        weight = sum(gain[code(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: len(order) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 60, "merged_rows": 7}, {"percent": 100, "min_words": 0}, {"percent": 0}, {"max_n": 3, "buckets": 50, "seed": 8, "percent": 40}, {"min_words": 10**6}])
def test_draw_is_exact(spark, docs, options):
    target = ["w1 w2 w3 w1 w2", "New York by the sea", None, ""]
    bench = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(target)], "item_id string, text string, score int")
    got = sorted((tuple(r) for r in resample.draw(docs, bench, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    named = {"buckets": "m"}
    want = _draw(corpus(), target, **{named.get(k, k): v for k, v in options.items() if k != "merged_rows"})
    assert got == want


def test_draw_with_ties_of_one_id(spark):
    """Rows of one id and text tie in full: exactly the wanted number of them is drawn, with ranks of their own."""
    rows = [(1, "a b c")] * 500 + [(i, "d e f") for i in range(2, 40)]
    out = resample.draw(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([("x", "a b c")], "item_id string, text string"), percent=50, min_words=1, merged_rows=40).collect()
    assert len(out) == 538 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 270))


def test_draw_of_nothing(spark, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert resample.draw(empty, bench).collect() == []


def test_features_of_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 64)
    rng = random.Random(3)
    texts = [prose(rng, 300), "x" * 1000 + " y " + "z" * 70 + " é" * 40, None, "", "one", prose(rng, 2), "A-b_c"]
    found = [Counter() for _ in texts]
    for own, bucket, _ in resample.features(texts, 3, 997):
        for i, b in zip(own.tolist(), bucket.tolist()):
            found[i][b] += 1
    assert found == [Counter(zlib.crc32(g.encode()) % 997 for g in _grams(t, 3)[1]) for t in texts]


def test_tournament_merges_any_runs():
    rng = random.Random(4)
    for k in (1, 2, 3, 5, 8, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(resample.Tournament(runs)) == sorted(x for r in runs for x in r)
    assert resample.natural_runs([3, 4, 4, 1, 2, 0]) == [[3, 4, 4], [1, 2], [0]]


# 13


def _mined(rows, max_words=5, min_count=100, scale=1000, share=100, top=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in found.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), b in found.items()):
            continue
        cuts = [(scale * a * total[lang] // (counts[lang, p[:j]] * counts[lang, p[j:]]), j, counts[lang, p[:j]], counts[lang, p[j:]]) for j in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("options", [{"min_count": 3}, {"min_count": 2, "share": 60, "top": 15}, {"min_count": 4, "max_words": 3, "broadcast_names": 0}, {"min_count": 2, "broadcast_names": 0}, {"min_count": 10**6}])
def test_phrases(docs, options):
    got = sorted(tuple(r) for r in phrases.mine(docs, **options).collect())
    assert got == _mined(corpus(), **{k: v for k, v in options.items() if k != "broadcast_names"})
    assert got or options["min_count"] > 5


def test_phrases_of_nothing(empty):
    assert phrases.mine(empty).collect() == []


@pytest.mark.parametrize("limit", [0, phrases.BROADCAST])
def test_phrases_across_segments_and_blocks(spark, limit):
    """One text of several segments and blocks: occurrences that begin in one and end in another count once."""
    rng = random.Random(6)
    words = [f"{'abcdefgh'[min(rng.randrange(8), rng.randrange(8))]}{'x' * 12}" for _ in range(150_000)]
    rows = [(1, " ".join(words), "en"), (2, None, "en")]
    got = sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "doc_id long, text string, lang string"), min_count=400, max_words=4, broadcast_names=limit).collect())
    assert got and got == _mined(rows, min_count=400, max_words=4)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n is 4.5e18 for 70 thousand million words; the same expression on made-up counts is exact."""
    a, n, left, right = 10**12 + 7, 7 * 10**13 + 1, 10**12 + 9, 10**12 + 8
    whole = "decimal(38,0)"
    df = spark.sql(f"select cast(cast(cast({a} as decimal(19,0)) * cast({n} as decimal(19,0)) as {whole}) * 1000 as {whole}) div cast(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)) as {whole}) as q")
    assert df.head()[0] == 1000 * a * n // (left * right)


def test_segments_are_small_rows(spark):
    """Readers and batches hold hundreds of segments at once, however long the texts are."""
    docs = spark.createDataFrame([("en", "a b " * 40_000)], "lang string, text string")
    names = spark.createDataFrame([(1, "en", "a"), (2, "en", "b")], "id long, lang string, phrase string")
    for small in (True, False):
        sizes = phrases.word_sequences(docs, names, small, 4).selectExpr("octet_length(at) + octet_length(id) as n").agg(F.max("n"), F.sum("n")).head()
        assert sizes[0] <= 1 << 16 and sizes[1] >= 12 * 80_000


def test_row_groups_of_long_rows(spark):
    import glob

    import pyarrow.parquet as pq

    long = spark.range(0, 600, 1, 1).selectExpr("array_join(transform(sequence(1, 100), i -> sha2(cast(id * 1000 + i as string), 256)), '') as x")
    kept = common.Stash(spark)(long, group_bytes=1 << 19)
    (file,) = glob.glob(f"{kept._zaslona_path}/*.parquet")
    assert pq.ParquetFile(file).num_row_groups > 1
