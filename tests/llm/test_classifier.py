import re

import numpy as np
import xxhash
from llm_samples import SMALL

from fotolake.llm import op10_quality_classifier as c


def test_labels_of_overlapping_labellers():
    rng = np.random.default_rng(0)
    counts, truth = {}, {}
    for _ in range(20_000):
        bad = rng.random() < 0.1
        code = 0
        for right in (0.9, 0.8, 0.7, 0.85):
            v = (2 if bad else 1) if rng.random() < right else (1 if bad else 2) if rng.random() < 0.2 else 0
            code = code * 3 + v
        counts[code] = counts.get(code, 0) + 1
        truth.setdefault(code, []).append(bad)
    got = c.fit_labels(counts, 4)
    wrong = sum(abs(got[k] - np.mean(v)) * len(v) for k, v in truth.items()) / 20_000
    assert wrong < 0.03


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet")
    got = {r.doc_id: r for r in c.classify(docs, labels.where("doc_id % 2 = 1")).collect()}
    assert len(got) == docs.count()
    rows = labels.where("doc_id % 2 = 0").collect()  # never seen in training
    lang = {r.doc_id: r.lang for r in docs.collect()}
    # So small a table has few toxic texts of other languages to learn from.
    toxic = [r.doc_id for r in rows if r.toxic and lang[r.doc_id] == "en"]
    clean = [r.doc_id for r in rows if not r.toxic and r.quality]
    junk = [r.doc_id for r in rows if not r.toxic and not r.quality]
    share = lambda ids: sum(got[i].kept for i in ids) / len(ids)
    assert share(toxic) < 0.03 and share(clean) > 0.97 and share(junk) < 0.15, (share(toxic), share(clean), share(junk))


def test_odd_texts(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = c.classify(odd, labels)
    assert got.columns == ["doc_id", "junk_score", "toxic_score", "kept"] and got.count() == odd.count()
    assert c.classify(odd.limit(0), labels.limit(0)).count() == 0
    assert c.keep_good(odd, labels).columns == odd.columns


def test_annotators_teach_other_languages(spark):
    text = lambda i, w: " ".join(f"mot{(i * 7 + j * 13) % 500}" for j in range(40)) + w
    docs = spark.createDataFrame([(i, text(i, " affreux" if i % 10 == 0 else "")) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(1000)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in c.classify(docs, labels).collect()}
    assert all(got[i] == (i % 10 != 0) for i in range(1000, 2000))


def test_scores_against_brute_force(spark):
    larger = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).selectExpr("doc_id", "text", "1 as Kept", "2 as junk_score")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    model = c.fit(docs, labels)
    assert np.count_nonzero(model.weights) > 3

    def hashed(x):
        return sum((b + 1) * pow(0x2545F4914F6CDD1D, i, 2**64) for i, b in enumerate(x)) % 2**64 + len(x) if len(x) <= 64 else xxhash.xxh64_intdigest(x)

    def brute(text):
        raw = (text or "").encode()
        place = lambda h: (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - c.BITS)
        found = {xxhash.xxh64_intdigest(f) >> (64 - c.BITS) for f in c.describe(raw)[1]}
        for w in set(re.findall(rb"[a-z0-9\x80-\xff]+", raw.lower())):
            found.add(place(hashed(w)))
            found |= {place(hashed(w[:k]) % 2**64 ^ 0xA5A5A5A5A5A5A5A5) for k in c.BEGINNINGS if len(w) > k}
        return [1 / (1 + np.exp(-(sum(float(model.weights[k, f]) for f in found) + model.bias[k]))) for k in (0, 1)]

    got = sorted(c.classify(docs, labels).collect(), key=str)
    want = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert len(got) == len(want)
    for a, b in list(zip(sorted(got, key=lambda r: r.doc_id), want, strict=True))[:120]:
        junk, toxic = brute(b.text)
        assert abs(a.junk_score - junk) < 1e-4 and abs(a.toxic_score - toxic) < 1e-4
        assert a.kept == (max(a.junk_score, a.toxic_score) < 0.5)


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 2_000_000), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert c.classify(docs, labels).count() == 3
