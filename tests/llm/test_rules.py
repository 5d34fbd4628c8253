import hashlib
import random
import re

import pytest
from llm_samples import ODD, SMALL

from fotolake.llm import op4_decontamination as d
from fotolake.llm import op9_quality_rules as q


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + j for i in at for j in range(8)}
    n, rep = len(w), len(hit)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_quality_counts(spark, odd):
    more = [(100 + i, t, "x") for i, t in enumerate(["a b c d e f g h " * 9, "x\ny\nx\n \n x", " ".join(map(str, range(40))) * 2, "a b c d e f g h i a b c d e f g h", "#*$%&|<>! A"])]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).selectExpr("*", "'en' lang", "1 as n_words", "'z' as hashes")
    for df in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        labels = spark.read.parquet(f"{SMALL}/labels.parquet")
        got = q.quality_rules(df, labels)
        assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        rows = [tuple(r) for r in got.collect()]
        assert sorted(map(str, (r[:7] for r in rows))) == sorted(str((r.doc_id, *brute_stats(r.text))) for r in df.collect())
        assert not any(r[6] and r[7] for r in rows)
    assert q.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_exact_bound():
    def cdf(k, n, p):
        from math import comb

        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for k, n, p, risk in ((0, 100, 0.05, 0.01), (0, 50, 0.05, 0.01), (3, 400, 0.02, 0.05), (12, 900, 0.02, 0.05)):
        assert q.upper_bound_holds(k, n, p, risk) == (cdf(k, n, p) <= risk)
    assert not q.upper_bound_holds(0, 0, 0.1, 0.1)


def test_cutoffs_reject_junk_and_spare_good_documents(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(2000)]
    junk = [(5000 + i, " ".join(f"w{i}y{j}%%%" for j in range(60)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1000)] + [(None, 1), (1, None), (1, 1)], "doc_id long, quality int")
    kept = {r.doc_id for r in q.quality_rules(docs, labels).where("kept").collect()}
    assert kept == set(range(2000))


def test_cutoffs_by_stratum_against_brute_force(spark):
    """Every number of the method anew, on a table with two languages, null languages, repeated rows and repeated ids."""
    r = random.Random(4)
    rows = []
    for i in range(1600):
        lang = (None, "en", "de", "xx")[min(3, i % 9)] if i % 9 < 3 else "en" if i % 2 else "de"
        rows.append((i, " ".join(f"w{r.randrange(10**6)}{'%' if r.random() < (0.3 if i % 40 == 0 else 0.01) else ''}" for _ in range(40)) + ("!" * r.randrange(30)), lang))
    rows += rows[:50] + [(5, "A B! C! D% " * 10, "en")]
    rows += [(9000 + i, f"x{i} y " * 3, "xx") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 1600)] + [(7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    stats = q.text_stats(docs, "lang")
    every = [x.asDict() for x in stats.collect()]
    half = {x.doc_id: x.h for x in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 9), 2) = 1 as h").collect()}
    shares = lambda x: {k: min(1000, x[a] * 1000 // max(1, x[b])) for k, (a, b) in q.RULES.items()}
    good = {}
    for x in every:
        if x["doc_id"] < 1600 and x["doc_id"] != 7:
            now = good.setdefault(x["doc_id"], (x["lang"], dict.fromkeys(q.RULES, 0)))
            for k, v in shares(x).items():
                now[1][k] = max(now[1][k], v)
    n = {s: sum(half[i] for i, g in good.items() if g[0] == s) for s in {g[0] for g in good.values()}}
    from math import comb

    bound = lambda k, m, rate, risk: m > 0 and k < m * rate and sum(comb(m, j) * rate**j * (1 - rate) ** (m - j) for j in range(k + 1)) <= risk
    tested = [s for s in n if bound(0, n[s], q.ALPHA, q.DELTA)]
    want = {}
    for s in tested:
        train = [g[1] for i, g in good.items() if g[0] == s and not half[i]]
        hold = [g[1] for i, g in good.items() if g[0] == s and half[i]]
        for step in q.STEPS:
            limits = {k: next((g for g in q.GRID if sum(x[k] > g for x in train) <= step * len(train)), 1000) for k in q.RULES}
            if not bound(sum(any(x[k] > limits[k] for k in q.RULES) for x in hold), len(hold), q.ALPHA, q.DELTA / len(tested)):
                break
            want[s] = limits
    assert len(want) >= 2 and q.cutoffs(stats, labels) == want
    kept = sorted((x.doc_id, x.kept) for x in q.quality_rules(docs, labels).collect())
    brute = [(x["doc_id"], not (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"] or any(v > want.get(x["lang"], {}).get(k, 1000) for k, v in shares(x).items()))) for x in every]
    assert kept == sorted(brute)


def brute_hits(docs, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pat.findall(lower(t))
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for i, t in docs:
        w = pat.findall(lower(t))
        hit, who = set(), set()
        for k in range(1, window + 1):
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    who |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("in_plan", [60_000, 3])
def test_decontamination(spark, odd, in_plan):
    items = [(1, "One two THREE four five six seven eight nine ten eleven."), (2, "école É-x"), (10, "one two three four five six seven eight nine ten"), (3, ""), (4, None), (5, "!!"), (6, "q")]
    texts = [
        "x one two three four five six seven eight nine ten eleven y", "ONE, two; three four five six seven eight nine ten", "É x", "École É x", "école É x", "x q z q",
        "one two three four five six seven eight nine " * 30, "one two three four five six seven eight nine ten " * 30,
    ]
    rows = [(i, t, "n", None) for i, t in enumerate(texts + ODD)] + [(0, texts[0], "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string, N_WORDS int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.decontamination_report(docs, bench, in_plan=in_plan)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_hits([r[:2] for r in rows], items)))
    real, tests = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = brute_hits([(r.doc_id, r.text) for r in real.collect()], [(r.item_id, r.text) for r in tests.collect()])
    assert sorted(map(tuple, d.decontamination_report(real, tests, in_plan=in_plan).collect())) == sorted(want)
    assert any(r[-1] for r in want)
    assert d.decontamination_report(docs, bench.limit(0), in_plan=in_plan).where("contaminated").count() == 0
    assert d.decontamination_report(docs.limit(0), bench, in_plan=in_plan).count() == 0


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A one, two three. B", "k"), (2, "clean", "k"), (3, None, "k"), (None, "x one two three", "k")], "doc_id long, text string, hits string")
    assert [r.doc_id for r in d.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    spans = d.decontaminate(docs, bench, "spans")
    assert spans.columns == docs.columns
    assert {r.doc_id: r.text for r in spans.collect()} == {1: "A. B", 2: "clean", 3: None, None: "x"}


@pytest.mark.parametrize("in_plan", [60_000, 1])
@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_removal_against_brute_force(spark, in_plan, mode):
    """Null and repeated ids, repeated rows, ties of items, a clashing column and a very long text."""
    items = [(1, "one two three"), (2, "one two three"), (3, " ".join(f"k{i}" for i in range(14))), (None, "clean"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = " ".join(f"k{i % 20}" for i in range(6_000))
    texts = [(None, "x one two three"), (None, "clean"), (None, None), (None, "One, two. THREE"), (7, "one two three"), (7, "clean too"), (7, "clean too"), (8, ""), (9, long), (9, long)]
    rows = [(i, t, "k") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Text_Key string")
    hit = [x[-1] for x in brute_hits(texts, [x for x in items if x[0] is not None])]
    got = d.decontaminate(docs, bench, mode, in_plan=in_plan)
    assert got.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    if mode == "documents":
        assert got == sorted((x for x, bad in zip(texts, hit, strict=True) if not bad), key=str)
        assert d.decontaminate(docs.limit(0), bench, in_plan=in_plan).count() == 0
    else:
        assert len(got) == len(texts) and [x for x in got if x[0] == 8 or x[1] is None] == [(8, ""), (None, None)]
        left = [len(re.findall(r"\w+", t)) for i, t in got if i == 9]
        assert left == [6_000 - n for i, _, n, *_ in brute_hits(texts, items[:3]) if i == 9] and left[0] > 0


def test_removal_tells_rows_apart_by_text(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x one two three"), (None, "clean"), (None, None), (7, "one two three"), (7, "clean too")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in d.decontaminate(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean"), (None, None), (7, "clean too")], key=str)
