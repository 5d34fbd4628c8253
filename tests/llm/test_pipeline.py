from llm_samples import SMALL
from test_jaccard import brute as groups
from test_pii import brute as personal
from test_rules import brute_hits

import corpus_pipeline as c


def test_stages(spark, tmp_path):
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(c.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == set(before)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if name == "n-gram Jaccard join":
            assert set(after) == {i for i, _, root in groups([(i, r.text) for i, r in before.items()]) if i == root}
        if name == "benchmark decontamination":
            assert set(after) == {r[0] for r in brute_hits([(i, r.text) for i, r in before.items()], tests) if not r[-1]}
        if name == "PII":
            assert set(after) == set(before)
            for i, r in after.items():
                assert (r.text == before[i].text) == (sum(personal(before[i].text)[:4]) == 0) and r.n_chars == len(r.text)
        if name == "quality classifier":
            assert 0.5 * len(before) < len(after) < len(before) and all(after[i] == before[i] for i in after)


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SMALL)
    key = ("doc_id", "piece")
    want = {tuple(r[k] for k in key): (r.start, r.length, r.ids_crc32) for r in docs.collect()}
    got = {tuple(r[k] for k in key): (r.start, r.length, r.ids_crc32) for r in c.run(spark, SMALL).collect()}
    assert got == want and len(got) > 0
