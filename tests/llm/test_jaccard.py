import random
import re

import numpy as np
import pytest
from llm_samples import ODD, SMALL

from fotolake.llm import op7_jaccard_join as j
from fotolake.llm.components import connected_components


def brute(rows):
    sets, ids = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        ids.append(i)
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets, strict=True)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, N int")
    return sorted(map(tuple, j.jaccard_join(docs).collect()), key=str)


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "one two three four five six"), (90, "One two  three four five SIX"), (None, "a"), (91, "A b c"), (92, "a B c")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_chains_and_shared_passages(spark, seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, 14)):
            copy = base[:]
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            if r.random() < 0.3:
                base = copy  # a chain that drifts away
    for k in range(25):
        rows.append((len(rows), " ".join([word() for _ in range(r.randint(3, 24))] + passage + [word() for _ in range(k % 3)])))
    r.shuffle(rows)
    got = run(spark, rows)
    assert got == brute(rows)


def test_small_table_with_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(j, "HOT", 3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(map(tuple, j.jaccard_join(docs).collect()), key=str)
    assert got == brute([(x.doc_id, x.text) for x in docs.collect()])


def test_answers_are_derived_from_similar_sets():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 62, 400).astype(np.uint64))
    sets = [np.unique(np.r_[base[r.random(len(base)) < 0.97], r.integers(0, 1 << 62, k % 9).astype(np.uint64)]) for k in range(60)]
    sets += [np.unique(r.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(60)]
    tile = j._Tile(sets)
    looked = []
    real = tile.met
    tile.met = lambda s: looked.append(len(s)) or real(s)
    for i, s in enumerate(sets):
        assert tile.common(i).tolist() == [len(np.intersect1d(s, x)) for x in sets]
    assert sum(looked) < 0.5 * sum(map(len, sets))


def test_long_texts_in_one_tile(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x " + long), (4, "w1 w2 w3 w4 w5 w6"), (5, "y" * 300_000 + " a b c d e"), (6, "y" * 300_000 + " a b c d e")]
    assert [r[2] for r in run(spark, rows)] == [1, 1, 1, 4, 5, 5]


def test_bitmap_keeps_every_id(spark):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "id")
    docs = spark.range(3000).selectExpr("id as doc_id", "'a b c' as text")
    classes = ids.selectExpr("id as sig", "1 as tag", "1 as n", "id")
    gathered = classes.selectExpr("sig", "tag", "n", "sig as head")
    got = [r.id for r in j.tiles(gathered, classes, docs).collect()]
    assert sorted(got) == list(range(0, 3000, 7))


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(map(tuple, j.jaccard_join(docs).collect()), key=str)
    assert got == brute([(x.doc_id, x.text) for x in docs.collect()])


def test_links_are_exact_and_span(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "x y")], "doc_id long, text string")
    _, links = j.jaccard_components(docs)
    assert [tuple(x) for x in links.collect()] == [(2, 1, 8)]


def test_every_link_is_counted(spark, monkeypatch):
    """A group of near copies, under several heads, has all its links, in one tile and in many."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(45):
        copy = base[:]
        for _ in range(k % 4):
            copy[r.randrange(len(copy))] = f"c{r.randrange(10_000)}"
        rows.append((k, " ".join(copy)))
    rows += [(50, rows[1][1]), (51, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (60, "x y"), (61, None)]
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(196)) if t and len(t) > 9 else frozenset() for _, t in rows]
    linked = {x: {y for i, y in zip(rows, sets, strict=True) if i[0] is not None and x and y and x != y and 7 * len(x & y) >= 3 * (len(x) + len(y))} for x in sets}
    want = sorted([(i, 0 if i is None else len(linked[x])) for (i, _), x in zip(rows, sets, strict=True)], key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile, hot in ((1_000_000, 100_000), (1500, 100_000), (1_000_000, 2), (1500, 2)):
        monkeypatch.setattr(j, "TILE", tile)
        monkeypatch.setattr(j, "HOT", hot)
        monkeypatch.setattr(j, "LEADERS", 24 if hot > 2 else 2)
        assert sorted(((x.doc_id, x.n_links) for x in j.jaccard_report(docs).collect()), key=str) == want
    pairs = j.jaccard_components(docs)[1].collect()
    assert len(pairs) == sum(len(linked[x]) for x in set(sets)) // 2 > 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 7), (None, 3), (200, 201)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 80, 90: 80, 201: 200}
