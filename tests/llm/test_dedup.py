"""Repeated strings, chunks, fingerprints and near duplicates against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import chunking, common, ctph, queries, similar, simhash, suffix
from gridloom.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
#: A null, empty and blank texts, ties, one word, letters beyond ASCII, a text of one character many times.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, "Word"), (6, "éÀ ñ 語 " * 40), (7, "a" * 5000), (8, "a" * 60), (None, "a" * 70)]


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(11)
    passage, found = words(r, 60), list(ODD)
    for i in range(10, 60):
        text = words(r, r.randint(5, 150))
        if i % 4 == 0:
            cut = r.randint(0, len(text))
            text = text[:cut] + passage[r.randint(0, 30) :] + text[cut:]
        if i % 5 == 0:
            before = found[r.randrange(9, len(found))][1] if len(found) > 10 else text
            w = before.split()
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        found.append((i, text))
    found.append((60, found[20][1]))
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    # other columns, some with names that operators use, must not matter
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", F.lit("x").alias("start"), F.lit(None).cast("string").alias("id"), F.lit(1).alias("score"), F.lit("y").alias("spans")).repartition(5)


def removed(rows, length):
    key = lambda d: -1 if d is None else d
    seen, out = {}, {}
    texts = [(key(d), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = min(d, seen.get(t[i : i + length], d))
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] < d:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_strings(spark, docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", hot)
    got = {-1 if r.doc_id is None else r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(docs).collect()}
    assert got == removed(rows, 50)


def test_repeated_strings_of_the_sample_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(df).collect()}
    assert got == removed([(r.doc_id, r.text) for r in df.collect()], 50)


def test_small_passes_and_other_lengths(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix, "MAP_BYTES", 300)
    got = {-1 if r.doc_id is None else r.doc_id: tuple(r)[1:] for r in suffix.remove_repeats(docs, length=30, seed=12).collect()}
    assert got == removed(rows, 30)


def test_texts_are_shuffled_once(spark, docs, rows):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        made = suffix.remove_repeats(docs, length=30, seed=12)
        got = {-1 if r.doc_id is None else r.doc_id: tuple(r)[1:] for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == removed(rows, 30)
    assert sum("ReusedExchange [doc_id" in x and "text" in x for x in plan.splitlines()) == 1


@pytest.mark.parametrize("length", [50, 5])
def test_doubling_over_every_position(spark, docs, rows, length):
    got = {-1 if r.doc_id is None else r.doc_id: tuple(r)[1:] for r in suffix.remove_spans(docs.select("doc_id", "text"), suffix.doubled_spans(docs, length)).collect()}
    assert got == removed(rows, length)


def test_doubling_gives_what_sampled_positions_give(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ways = [suffix.remove_spans(df, spans).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") for spans in (suffix.doubled_spans(df), suffix.repeated_spans(df))]
    assert ways[0].count() == df.count() and ways[0].exceptAll(ways[1]).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert suffix.doubled_spans(none).count() == 0


def test_kept_text_and_repeated_rows(spark):
    text = "abcdefghij" * 9
    df = spark.createDataFrame([(1, text), (1, text), (2, "x" + text)], DOCS)
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in suffix.remove_repeats(df, keep_text=True).collect())
    assert got == [(1, 0, text), (1, 0, text), (2, 90, "x")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix.remove_repeats(none).count() == 0
    assert chunking.remove_chunks(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert similar.drop_near_duplicates(none).count() == 0
    assert ctph.edit_likeness(none).count() == 0


# chunks


def gear_cuts(data, bits, least, most):
    cuts, start, table = [], 0, chunking._GEAR
    h = 0
    good = set()
    for i, b in enumerate(data):
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        if i >= 31 or True:
            good.add(i + 1) if h >> (32 - bits) == 0 else None
    marks = sorted(good | {0, len(data)})
    full = []
    for a, b in zip(marks[:-1], marks[1:], strict=True):
        full += [a, *range(a + most, b, most)]
    full.append(len(data))
    while start < len(data):
        stop = next((m for m in full if m >= start + least), len(data))
        cuts.append((start, stop))
        start = stop
    return cuts


def test_gear_boundaries():
    r = np.random.default_rng(1)
    for size in (0, 1, 31, 500, 3000):
        data = r.integers(97, 110, size).astype(np.uint8)
        start, stop = chunking.boundaries(data, np.array([0, size]), 4, 32, 256)
        assert list(zip(start.tolist(), stop.tolist(), strict=True)) == gear_cuts(data.tolist(), 4, 32, 256)
    start, stop = chunking.boundaries(np.zeros(1000, np.uint8), np.array([0, 1000]), 5, 32, 100)
    assert (stop - start).max() <= 132 and (stop - start).sum() == 1000


@pytest.mark.parametrize("size", [1, 3, 100])
def test_rows_stream_past_the_first_owner(size):
    r = random.Random(size)
    rows = sorted((r.randrange(3), r.randrange(2), r.randrange(6), r.randrange(9), 9, r.random() < 0.1) for _ in range(80))
    first = {}
    for one, two, doc, *_ in rows:
        first.setdefault((one, two), doc)
    cells = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_()], strict=True)], ["one", "two", "doc_id", "start", "stop", "settled"])
    batches = [cells.slice(i, size) for i in range(0, len(rows), size)] + [cells.slice(0, 0)]
    got = [tuple(x.values()) for b in chunking._later(iter(batches)) for x in b.to_pylist()]
    assert got == [(doc, start, stop) for one, two, doc, start, stop, settled in rows if settled or doc > first[one, two]]


def test_chunks_resist_insertions_and_leave_clean_documents(spark):
    r = random.Random(3)
    passage = words(r, 80)
    rows = [(i, words(r, 50) + " " + passage + " " + words(r, 50)) for i in range(6)] + [(i, words(r, 150)) for i in range(6, 12)] + ODD[:8][0:3]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {x.doc_id: x for x in chunking.remove_chunks(spark.createDataFrame(rows, DOCS), keep_text=True).collect()}
    assert got[0].n_removed == 0
    assert all(got[i].n_removed > 0.5 * len(passage) for i in range(1, 6))
    assert all(got[i].n_removed == 0 for i in range(6, 15))
    assert all(got[i].n_bytes == len((t or "").encode()) for i, t in rows)


@pytest.mark.parametrize("run", [0, 64])
def test_chunk_removal_by_brute_force(spark, docs, rows, run):
    key = lambda d: suffix.NULL_ID if d is None else d
    first, spans = {}, {}
    for d, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        start, stop = chunking.boundaries(data, np.array([0, len(data)]), 5, 32, 1024)
        spans[key(d)] = [(a, b, bytes(data[a:b])) for a, b in zip(start, stop, strict=True)]
        for _, _, c in spans[key(d)]:
            first[c] = min(key(d), first.get(c, key(d)))
    want = {}
    for d, found in spans.items():
        runs, last = [], None
        for a, b, c in found:
            if first[c] < d:
                if last == a:
                    runs[-1] += b - a
                else:
                    runs.append(b - a)
                last = b
        runs = [n for n in runs if n >= run]
        want[d] = (sum(runs), len(runs))
    got = {key(r.doc_id): (r.n_removed, r.n_spans) for r in chunking.remove_chunks(docs, run=run).collect()}
    assert got == want


def test_the_query_removes_short_repeated_chunks(spark, tmp_path):
    rows = [(1, "a short text"), (2, "a short text"), (3, "another one"), (4, None), (5, "")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in queries.op8_chunk_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0), 2: (12, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


# fingerprints


def simhash_of(text, size):
    found = (text or "").encode().lower().split()
    parts = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("tile", [1024, 2])
def test_simhash_groups(spark, docs, rows, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    prints = [simhash_of(t, 3) for _, t in rows]
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = sorted((str(d), f"{prints[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


def test_bit_counts_of_long_texts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    starts, sizes = np.array([0, 3, 700]), np.array([3, 697, 300])
    got = simhash._bit_counts(h, starts, sizes)
    want = [[int((h[s : s + n] >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)] for s, n in zip(starts, sizes, strict=True)]
    assert got.tolist() == want


def test_near_duplicates_by_jaccard(spark, docs, rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    alike = lambda i, j: (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * max(1, len(sets[i] | sets[j]))
    root = groups(len(rows), alike)
    order = lambda i: suffix.NULL_ID if rows[i][0] is None else rows[i][0]
    keep = {}
    for i in range(len(rows)):
        keep[root[i]] = min(keep.get(root[i], order(i)), order(i))
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {suffix.NULL_ID if r.doc_id is None else r.doc_id for r in kept.collect()} == set(keep.values())


def test_plans_read_each_table_a_few_times(spark, monkeypatch):
    """The driver holds a plan whole and plans it anew after each shuffle, so none repeats what was made before at each use of it."""
    read = []

    def noted(df, keep=similar.written):
        read.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return keep(df)

    monkeypatch.setattr(similar, "written", noted)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), "something else", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in similar.drop_near_duplicates(docs).collect()) == [0, 2, 3]
    assert max(read) <= 10, read


def test_large_groups_of_near_copies(spark):
    """More rows than a tile of any size here, most of them no nearer to each other than to the text they come from."""
    r = random.Random(7)
    base = words(r, 120).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    root = groups(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = similar.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root))


def test_near_copies_that_repeat_a_line(spark):
    """Similarity is that of sets: how often one copy repeats a line must not part it from the other."""
    r, rows = random.Random(17), []
    for i, m in enumerate((20, 35, 50, 75, 100)):
        text, line = words(r, 400), words(r, 12)
        rows += [(2 * i, f"{text} {line}"), (2 * i + 1, " ".join([text, *[line] * m]))]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    root = groups(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert sorted(set(root)) == [0, 2, 4, 6, 8]
    kept = similar.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 2, 4, 6, 8]


@pytest.mark.parametrize("tile", [1024, 2])
def test_near_copies_that_share_no_least_hash(spark, tile, monkeypatch):
    """Short texts of 4 and 5 shingles at exactly 0.8 among them, whose fingerprints are often far apart."""
    monkeypatch.setattr(similar, "TILE", tile)
    r, rows = random.Random(23), []
    for i in range(400):
        n = r.choice([8, 8, 8, 9, 20, 60])
        w = [f"{r.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, *["more"] * ((n - 4) // 4)]))]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    root = groups(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    # the cheap first pass is made to find next to nothing: the second one must find every link
    for mins in (6, 1):
        found = {x.node: x.component for x in similar.similar_groups(spark.createDataFrame(rows, DOCS), mins=mins).collect()}
        assert [found.get(d, d) for d, _ in rows] == root


def test_null_and_shared_ids_are_told_apart_by_their_texts(spark):
    r = random.Random(29)
    w = words(r, 200).split()
    near = [" ".join([*w[:k], "other", *w[k + 1 :]]) for k in (3, 60, 150)]
    for ids, left in (((1, 2, 3, 4), {1, 4}), ((7, 7, 7, 7), {7}), ((None, None, None, 5), {None, 5})):
        rows = list(zip(ids, [*near, words(r, 80)], strict=True))
        docs = spark.createDataFrame(rows, DOCS)
        kept = similar.drop_near_duplicates(docs).collect()
        assert len(kept) == 2 and rows[3] in [tuple(x) for x in kept]
        assert {x.doc_id for x in kept} == left
    twice = spark.createDataFrame([(1, near[0]), (1, near[0]), (None, None), (None, ""), (2, " ")], DOCS)
    kept = [tuple(x) for x in similar.drop_near_duplicates(twice).collect()]
    assert len(kept) == 2 and (1, near[0]) in kept


def test_columns_of_any_name_stay(spark):
    names = ["one", "two", "node", "component", "r", "rid", "c0", "c1", "kept", "a.b", "size"]
    docs = spark.createDataFrame([(1, "some words here", *names), (2, "some words here", *names), (3, "others", *names)], ["doc_id", "text", *names])
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(x) for x in kept.collect()) == [(1, "some words here", *names), (3, "others", *names)]


def test_no_pair_of_the_sample_tables_is_lost(spark):
    """Recall against brute force on all documents of sf0.01: every pair of 0.8 or more is in one group, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((x.doc_id, x.text or "") for x in docs.collect())
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset())
    root = groups(len(rows), lambda i, j: sets[i] == sets[j] or min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    found = {x.node: x.component for x in similar.similar_groups(docs).collect()}
    assert [found.get(d, d) for d, _ in rows] == [rows[k][0] for k in root]
    assert len(found) > 100


@pytest.mark.parametrize("s", [0.8, 0.5])
def test_places_and_sizes_rule_out_no_similar_pair(s):
    """For random similar sets: their first common member passes, however sizes and places were rounded."""
    r, common = random.Random(31), np.zeros(similar.COUNTERS, np.uint8)
    for _ in range(300):
        both = r.randrange(1, 300)
        extra = int(both * (1 / s - 1))
        k = r.randint(0, extra)
        values = np.array(r.sample(range(1 << 48), both + extra), np.uint64)
        x, y = np.sort(values[: both + k]), np.sort(np.concatenate([values[:both], values[both + k :]]))
        p, q = similar.prefix(x, common, s), similar.prefix(y, common, s)
        first = min(set(p.tolist()) & set(q.tolist()))
        facts = []
        for found, part in ((x, p), (y, q)):
            place = np.floor(np.array([part.tolist().index(first)]) / (len(found) * (1 - s)) * similar._PLACES).clip(0, 255).astype(np.uint8)
            facts += [np.array([np.floor(np.log(len(found)) / np.log(similar._STEP))], np.uint16), place]
        assert similar.compatible(*facts, s).all()


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (0, 1, 5, 40, 900, 2500)]
    x, y = np.divmod(np.arange(36), 6)
    packed = similar._Parities([similar.parity(s) for s in sets])
    far = packed.far(x, y)
    assert all(f <= len(np.setxor1d(sets[i], sets[j])) for f, i, j in zip(far, x, y, strict=True))
    assert far[0] == 0 and far[5] > 0 and packed.words[5] > packed.words[3]


@pytest.mark.parametrize("local", [100_000, 7])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 102), (100, 102)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# piecewise hashing


def test_edit_distances():
    r = random.Random(2)
    letters = ctph._ALPHABET.tobytes()[:5]

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    a, b = ([bytes(r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 63, 64]))) for _ in range(80)] for _ in range(2))
    assert ctph.distances(a, b).tolist() == [slow(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("bucket", [2000, 7])
def test_edits(spark, docs, rows, bucket):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda x: (suffix.NULL_ID if x[0] is None else x[0], x[1]))
    got = {r.doc_id: r for r in ctph.edit_likeness(docs, bucket).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        one, two, three = (ctph.fingerprint(x.encode()) for x in (t, edited, after))
        assert (got[d].n_chars, got[d].edited_sha256, got[d].fingerprint, got[d].edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), ctph.shown(one), ctph.shown(two))
        assert got[d].near_edited == ctph.likeness([one], [two])[0] and got[d].near_next == ctph.likeness([one], [three])[0]


def test_likeness_tells_edits_from_other_texts(spark):
    rows = ctph.edit_likeness(spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 400")).toPandas()
    assert (rows.near_edited > 0.5).mean() > 0.97
    assert (rows.near_edited > rows.near_next).mean() > 0.97


def test_one_document_follows_itself(spark):
    r = ctph.edit_likeness(spark.createDataFrame([(5, "abcdefgh")], DOCS)).first()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (8, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)


def test_signatures_by_brute_force():
    """Byte by byte: the rolling hash of eight bytes, chunks that end where it triggers, one character for each."""
    mask, multiplier = 0xFFFFFFFF, 0x01000193
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    table = [int(x) for x in ctph._BYTE]

    def signature(hashes, block):
        out, piece, held = "", 0, 0
        for h in hashes:
            piece, held = (piece + h * 0x9E3779B1) & mask, held + 1
            if h % block == block - 1 and len(out) < 63:
                out, piece, held = out + letters[piece >> 26], 0, 0
        return out + letters[piece >> 26] if held else out

    def slow(data):
        if not data:
            return "1::"
        hashes, recent = [], []
        for byte in data:
            recent = [byte, *recent[:7]]
            h = 0
            for x in reversed(recent):
                h = (h * multiplier + table[x]) & mask
            h = (h ^ h >> 15) * 0x2C1B3C6D & mask
            hashes.append(h ^ h >> 13)
        block = 1
        while block * 64 < len(data):
            block *= 2
        while block > 1 and len(signature(hashes, block)) < 32:
            block //= 2
        return f"{block}:{signature(hashes, block)}:{signature(hashes, 2 * block)}"

    r = random.Random(41)
    texts = [b"", b"a", b"ab" * 3, b"a" * 5000, words(r, 3).encode(), words(r, 700).encode(), bytes(r.randrange(256) for _ in range(4097)), "é語 ".encode() * 300]
    assert [ctph.shown(ctph.fingerprint(x)) for x in texts] == [slow(x) for x in texts]
