"""Vector codes, exact duplicates and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import codes, exact, phrases

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == length]
    cut = codes.bounds(length, parts)
    whole = [[int(np.floor(256.0 * x)) for x in r[1]] for r in rows]
    books = [[tuple(v[a:b]) for v in whole[:entries]] for a, b in cut]
    away = lambda u, v: sum((x - y) ** 2 for x, y in zip(u, v, strict=True))
    pick = lambda v, book: min(range(len(book)), key=lambda i: (away(v, book[i]), i))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            own = defaultdict(list)
            for v in whole:
                own[pick(v[a:b], books[p])].append(v[a:b])
            books[p] = [tuple(sum(c) // len(own[i]) for c in zip(*own[i], strict=True)) if i in own else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, sums = [], Counter()
    for r, v in zip(rows, whole, strict=True):
        got = [pick(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        error = sum(away(v[a:b], books[p][i]) for (p, (a, b)), i in zip(enumerate(cut), got, strict=True))
        out.append((r[0], "".join(f"{i:02x}" for i in got), error, r[2]))
        sums[r[2]] += error
    return sorted(((*x, sums[x[3]], digest) for x in out), key=str)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("length", [32, 37])
def test_codes_by_brute_force(spark, length):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.4, length).astype(np.float32).tolist(), int(i) % 3 if i % 7 else None) for i in range(150)]
    rows += [(200 + i, rows[5][1], 1) for i in range(40)]  # a hot vector
    bad = lambda x: [x, *rows[0][1][1:]]
    rows += [(300, None, 1), (301, bad(None), 1), (302, bad(float("nan")), 1), (303, bad(float("inf")), None), (304, [1.0], 2), (7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("a.b`c", F.lit(1)).repartition(5)
    assert plain(codes.compress(df)) == brute_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = [(2, [0.5] * 16, None), (1, [-0.003] * 16, 4)]
    assert plain(codes.compress(spark.createDataFrame(few, kind))) == brute_codes(few)
    for rows in ([], [(1, None, 1)], [(1, [None], 1)]):
        none = codes.compress(spark.createDataFrame(rows, kind))
        assert none.count() == 0
        assert none.columns == ["vec_id", "code", "error", "label", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], kind)).collect()


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 16])
def test_nearest_is_exact(length):
    r = np.random.default_rng(length)
    for scale in (1, 40, 1 << 24):
        x, book = r.integers(-scale, scale + 1, (300, length)), r.integers(-scale, scale + 1, (64, length))
        x[:64] = book
        book[7] = book[3]
        away = ((x[:, None, :] - book) ** 2).sum(axis=2)
        entry, least = codes.nearest(x, book)
        assert np.array_equal(entry, away.argmin(axis=1))
        assert np.array_equal(least, away.min(axis=1))


def test_labels_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert plain(codes.compress(df)) == brute_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()])


# exact duplicates


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(A_Z)].append(d)
    out = []
    for norm, ids in groups.items():
        known = [d for d in ids if d is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        left = 1
        for d in ids:
            stays = d == best and left > 0
            left -= stays
            out.append((d, best, len(ids), stays, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    base = ["".join(r.choice("abAB é") for _ in range(r.randint(0, 5))) for _ in range(60)]
    rows = [(i, r.choice(base)) for i in range(300)] + [(None, base[0]), (None, "alone"), (5, "two texts"), (5, None), (6, ""), (7, "É"), (8, "é"), (9, "İ"), (9, "İ")]
    rows += [(1000 + i, "Many copies " * 3 if i % 2 else "many COPIES " * 3) for i in range(2500)]
    long = "x" * 200_000
    return [*rows, (9000, long), (9001, long + "y"), (9002, long.upper()), (None, "many copies " * 3)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_by_brute_force(spark, texts, keep):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("norm", F.lit(1)).withColumn("hash", F.lit(2)).repartition(7)
    assert plain(exact.exact_duplicates(df, keep=keep)) == brute_groups(texts, keep)


def test_equal_hashes_do_not_make_groups(spark, texts, monkeypatch):
    # with one hash for all texts the whole texts still decide
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    few = texts[:330]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert plain(exact.exact_duplicates(df, keep="largest")) == brute_groups(few, "largest")


def test_hot_groups_with_equal_hashes(spark, texts, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long") if c == ("norm",) else real(*c))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert plain(exact.exact_duplicates(df)) == brute_groups(texts, "smallest")


def test_one_row_of_each_group_stays(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("a.b`c", F.lit(1)).withColumn("digest", F.lit("d"))
    left = exact.drop_exact_duplicates(df)
    assert left.columns == df.columns
    want = Counter((d, h) for d, _, _, stays, h in brute_groups(texts, "smallest") if stays)
    assert Counter((r.doc_id, hashlib.sha256((r.text or "").translate(A_Z).encode()).hexdigest()) for r in left.collect()) == want
    none = df.limit(0)
    assert exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact_duplicates(none).count() == 0


# collocations


def brute_phrases(rows, most=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(A_Z)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, most + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    held[p[i : i + size]] = max(a, held.get(p[i : i + size], 0))
        scored = []
        for p, a in found.items():
            if p in held and 100 * held[p] >= cover * a:
                continue
            score, _, l, r = min((int(Fraction(1000000 * a * a, count[p[:k]] * count[p[k:]])), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), a, l, r, score))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (*_, p, a, l, r, s) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made_texts(seed, n=400):
    r = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "été", "日本", "a b", "x", "NUL\x00", "r2"]
    some = [" ".join(r.choice(words[: 2 + i % 9]) + r.choice(["", "", "", ",", ".", "\t", "\r\n", " !"]) for _ in range(r.randint(0, 60))) for i in range(n)]
    rows = [(r.choice(["en", "fr", None, "und"]), t) for t in some]
    return [*rows, ("en", None), ("en", ""), ("fr", " \t , . "), (None, "new york " * 3000), ("de", "only few words"), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize(("most", "top", "shard"), [(3, 2000, 16 << 20), (3, 5, 500), (2, 2000, 3000), (4, None, 3000), (5, 50, 1 << 20)])
def test_collocations_by_brute_force(spark, monkeypatch, most, top, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rows = made_texts(most)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("p")).withColumn("f", F.lit(1)).repartition(4)
    got = plain(phrases.collocations(df, most=most, top=top))
    assert got == brute_phrases(rows, most=most, top=top or 10**9)
    assert len(got) > 20 or top == 5


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = made_texts(3)
    assert plain(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute_phrases(rows)


def test_counts_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    known = [("x", "", 0, 9 * big), ("x", "a", 1, 3 * big), ("x", "b", 1, 2 * big), ("x", "a b", 2, big + 1)]
    monkeypatch.setattr(phrases, "frequencies", lambda *_: spark.createDataFrame(known, "lang string, phrase string, words int, f long"))
    (row,) = phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    assert row.score == 1000000 * (big + 1) ** 2 // (6 * big * big)


def test_no_texts_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


def test_automaton_counts_every_string():
    r = random.Random(9)
    word = np.array([r.randint(0, 3) for _ in range(500)])
    sort = np.array([i // 250 for i in range(500)])
    new = np.array([i % 250 == 0 or r.random() < 0.2 for i in range(500)])
    place = np.arange(500) - np.maximum.accumulate(np.where(new, np.arange(500), 0))
    want = Counter((sort[i], *word[i - k + 1 : i + 1].tolist()) for i in range(500) for k in range(1, 5) if place[i] >= k - 1)
    got = {}
    for size, end, n in phrases.automaton(word, sort, place, 4):
        got |= {(sort[e], *word[e - size + 1 : e + 1].tolist()): c for e, c in zip(end, n.tolist(), strict=True)}
    assert got == want
