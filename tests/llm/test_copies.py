"""Exact dedup, n-gram Jaccard join, substring dedup, decontamination: against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from patternloom.llm import components, decontaminate, exact_dedup, jaccard_join, substring_dedup


def rows(df):
    return {r[0]: r for r in df.collect()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, texts, weak):
    options = {"digest": lambda t: F.substring(F.crc32(t.cast("binary")).cast("string"), 1, 1).cast("binary")} if weak else {}
    got = rows(exact_dedup.exact_dedup(docs, **options))
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(texts)
    for ids in same.values():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids))


def test_exact_dedup_nulls_and_empty(spark, nothing):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (4, None), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).where("doc_id is not null or group_size = 1").collect())
    assert got == [(False, 3, 3, 2, True), (False, 4, 4, 2, False), (False, 4, 4, 2, True), (True, None, None, 1, True)]
    again = spark.createDataFrame([(i % 2, "a  b" if i % 3 else "c", 1) for i in range(60)] + [(None, "d", 2)] * 3, "doc_id long, text string, copies long")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(again).collect()]
    assert len(got) == 63 and [r for r in sorted(got, key=str) if r[3]] == [(0, 0, 20, True), (0, 0, 40, True), (None, None, 3, True)]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_stays_in_the_jvm(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def component_of(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("look,limit", [(8, 500_000), (1, 0)])
def test_jaccard(docs, texts, look, limit):
    got = rows(jaccard_join.jaccard_components(docs, look=look, small_rows=limit))
    sets, want = component_of(texts)
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}


def test_jaccard_large_group_and_edges(spark, nothing):
    words = [f"w{k}" for k in range(200)]
    near = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(0, 200, 5)]
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(near)), (90, near[0]), (None, near[0]), (None, None)], "doc_id long, text string")
    got = jaccard_join.jaccard_components(df).collect()
    assert {r.component_id for r in got if r.n_shingles} == {0} and len(got) == len(near) + 3
    one = jaccard_join.one_of_each(df)
    assert sorted(str(r.doc_id) for r in one.collect()) == ["0", "None"] and one.columns == ["doc_id", "text"]
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_repeated_rows(spark):
    """Rows that repeat id and text are one set; the work doesn't grow with the square of their number."""
    words = [f"w{k}" for k in range(40)]
    other = " ".join([*words[:39], "x"])
    df = spark.createDataFrame([r for k in range(300) for r in [(1, " ".join(words)), (2, other)]] + [(3, "a b c d e f g")], "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_components(df).collect()
    assert len(got) == 601 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(df).collect()) == [1, 3]


def test_jaccard_random_families(spark):
    """Trees of mutated copies, where many pairs are just below the threshold."""
    rng = random.Random(5)
    out = []
    for _ in range(4):
        family = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) + str(rng.randrange(30)) for _ in range(rng.randrange(30, 150))]]
        while len(family) < 45:
            w = list(rng.choice(family))
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"m{rng.randrange(200)}"
            family.append(w)
        out += [" ".join(w) for w in family]
    rng.shuffle(out)
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    got = rows(jaccard_join.jaccard_components(df))
    assert [got[i].component_id for i in range(len(out))] == component_of(out)[1]


def test_words_are_hashed_together():
    """Words as split() cuts them, whatever their length; no Python call for each word."""
    import sys

    from patternloom.llm.common import hashed_words

    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abAB \t\n\x0b\x0c\r\x00\x1c\xc3\xa9") for _ in range(rng.randrange(90))) for _ in range(900)]
    texts += [b"", b" ", *(b"x" * n for n in range(1, 140)), b"y" * 64 + b" " + b"y" * 65]
    hashes, counts = hashed_words(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len({*zip(words, hashes.tolist())}) == len({*words}) == len({*hashes.tolist()})

    def calls(text):
        n = 0

        def note(*_):
            nonlocal n
            n += 1

        sys.setprofile(note)
        list(jaccard_join.shingles([text], 5))
        sys.setprofile(None)
        return n

    assert calls(" ".join(f"w{i}" for i in range(9000)).encode()) <= calls(b"a b c d e f g h i j") + 20


def test_bucket_columns():
    """Columns of packed values, with nulls and slices, come back as they were; marked and repeated keys are found."""
    import numpy as np
    import pyarrow as pa

    from patternloom.llm import keyed

    values = [b"ab", None, b"", b"cde", b"f"]
    data, size = keyed.joined(pa.chunked_array([pa.array(values, pa.binary())[1:], pa.array([], pa.binary()), pa.array(values, pa.binary())]))
    assert data.tobytes() == b"cdefabcdef" and size.tolist() == [0, 0, 3, 1, 2, 0, 0, 3, 1]
    assert keyed.binary(data, size).to_pylist() == [b"", b"", b"cde", b"f", b"ab", b"", b"", b"cde", b"f"]
    assert keyed.shared(np.array([5, 1, 5, 2, 3], np.uint64), np.array([0, 0, 0, 1, 0], bool)).tolist() == [True, False, True, True, False]


def test_one_of_each_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "r"), (2, "a b c", 6, "s")], "doc_id long, text string, number long, row string")
    got = jaccard_join.one_of_each(df).collect()
    assert [tuple(r) for r in got] == [(1, "a b c", 5, "r")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 105), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 105: 100}


def cut(texts, n=35):
    seen = {}
    split = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), []).append((i, k))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + n))
    return [(len(w), len(g), b" ".join(x for k, x in enumerate(w) if k not in g).decode()) for w, g in zip(split, gone)]


def test_substring_dedup(docs, texts, nothing):
    got = rows(substring_dedup.substring_dedup(docs, keep=["lang", "row"]))
    assert got[0].lang in ("en", "fr", None)
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_text) for i in range(len(texts))] == cut(texts)
    assert got[0].row == 7
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_substring_dedup_inside_one_text(spark):
    w = [f"w{k}" for k in range(40)]
    text = " ".join([*w, "mid", *w, "end", *w[:34]])
    df = spark.createDataFrame([(1, text), (1, text[:50]), (None, None)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == sorted((a, b) for a, b, _ in cut([text, text[:50], None]))


ITEMS = [(1, "Alpha beta gamma delta, epsilon zeta eta theta iota kappa"), (2, "short item here"), (3, None), (4, "..."), (10, "ALPHA BETA gamma delta epsilon zeta eta theta"), (None, "lone é word"), (2, "other short text")]
HELD = ["x alpha beta gamma delta epsilon zeta eta theta y", "Short ITEM here; other-short text", "beta gamma delta epsilon zeta eta theta iota", "lone é word alpha beta", "é word", None, ""]


@pytest.mark.parametrize("block", [200_000, 2])
def test_decontamination(spark, block, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HELD)], "doc_id long, text string, n_hit long")
    got = rows(decontaminate.contamination(df, items, block_windows=block))
    assert [(r.n_words, r.n_hit, r.items, r.contaminated) for _, r in sorted(got.items())] == [
        (10, 8, ["1", "10"], True), (6, 6, ["2"], False), (8, 8, ["1"], False), (5, 3, ["null"], False), (2, 0, [], False), (0, 0, [], False), (0, 0, [], False),
    ]
    assert decontaminate.contamination(nothing, items).count() == 0
    assert {r.n_items for r in decontaminate.contamination(df, items.limit(0)).collect()} == {0}
    assert decontaminate.item_digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()


def hits_of(texts, items, window):
    """Brute force: per text, number of words hit and names of items found."""
    windows = {}
    for name, text in items:
        w = decontaminate.words_of((text or "").encode())
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    out = []
    for t in texts:
        w = decontaminate.words_of((t or "").encode())
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block,shingle", [(200_000, 3), (7, 4), (50, 1)])
def test_decontamination_random(spark, block, shingle):
    rng = random.Random(block)
    some = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(i // 2, some(rng.randrange(0, 30))) for i in range(30)]
    held = [some(rng.randrange(0, 60)) for _ in range(40)] + [items[3][1], f"x {items[5][1]} y {items[5][1]}"] * 2
    df = spark.createDataFrame([(i % 9, t, i) for i, t in enumerate(held)], "doc_id long, text string, kept long").repartition(3)
    got = {r.kept["kept"]: (r.n_hit, r["items"]) for r in decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"), shingle=shingle, block_windows=block, keep=["kept"]).collect()}
    assert [got[i] for i in range(len(held))] == hits_of(held, items, 8)


def test_decontamination_long_item(spark):
    """An item of many distinct words, cut into blocks: no window is lost, whatever the shingle."""
    words = [f"w{k}" for k in range(150_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[70_000:70_008])), (3, " ".join(words[::2]))], "doc_id long, text string")
    out = decontaminate.contamination(df, spark.createDataFrame([(5, " ".join(words))], "item_id long, text string"), shingle=4, block_windows=60_000)
    assert [(r.doc_id, r.n_hit) for r in out.orderBy("doc_id").collect()] == [(1, 150_000), (2, 8), (3, 0)]
