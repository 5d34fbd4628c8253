import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_samples import ODD, SMALL
from tokenizers import Tokenizer

from fotolake.llm import op1_token_counts, op2_packing, op6_token_files
from fotolake.llm.tokens import Encoder, prove, read_vocabulary

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


MORE = [
    "it's's we'll'd 'tis ''s .'s \n's don'ta 1's2", "a\nb\n\nc\n\n\nd\n\n", "\n", "\n\n", " ", " a ", "a \nb", "a\n b", "x\0y\0", "\0", "a_b__c _ __ 1_2", "x" * 40 + " " + "é" * 40 + "!" * 50, "naïve Straße œuvre año ÀÉÎ ß",
    "ab 12ab34 5.6,7;8 ...a", "'", "''", "'s", " 's", "a' s", "'re've'm 'LL 'Ll",
]


def _small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("bits", [20, 3])
def test_pretokens_give_the_librarys_ids(spark, path, bits):
    texts = ODD + MORE + [r.text for r in _small(spark).collect()][: 60 if bits > 5 else 5]
    tok = Tokenizer.from_file(path)
    enc = Encoder(prove(read_vocabulary(path)), bits)
    if bits == 3:
        enc.POOL = enc.SPARE = 50
        enc._forget()
    assert enc.kind != "other" and enc.merger is not None
    assert list(enc.count(texts)) == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_blocks_of_long_texts(monkeypatch):
    from fotolake.llm import tokens

    text = "Some words, that  repeat\n and more. " * 400
    monkeypatch.setattr(tokens, "BLOCK", 100)
    for path in (BYTES, WORDS):
        (got,) = Encoder(prove(read_vocabulary(path))).encode([text])
        assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert "".join(tokens.safe_blocks(text, 50)) == text


def test_counts(spark, odd):
    tok = Tokenizer.from_file(BYTES)
    for docs in (odd, _small(spark)):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect())
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts.token_counts(docs, BYTES).collect())
        assert got == want
    assert op1_token_counts.token_counts(odd.limit(0), BYTES).count() == 0


def test_whole_strings_are_proven():
    whole = op1_token_counts.whole_strings(prove(read_vocabulary(BYTES)))
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole


def test_packing(spark, odd):
    tok = Tokenizer.from_file(WORDS)
    for docs in (odd, _small(spark)):
        ids = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
        want = sorted((str(d), k // 4096, k, len(p := x[k : k + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for d, x in ids for k in range(0, len(x), 4096))
        rows = op2_packing.pack_documents(docs, WORDS).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        seqs = {}
        for r in rows:
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 4096
        total = sum(r.length for r in rows)
        assert len(seqs) <= 1.1 * total / 4096 + 1
    assert op2_packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_plan_is_best_fit_decreasing():
    import random

    r = random.Random(1)
    for _ in range(50):
        cap = r.randint(5, 40)
        sizes = [r.randint(1, cap) for _ in range(r.randint(1, 200))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [x for x in rooms if x >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(cap - s)
        hist = {s: sizes.count(s) for s in set(sizes)}
        plan = op2_packing.plan(hist, cap)
        assert sum(p[2] for p in plan) == len(sizes)
        assert 1 + max(p[4] + (p[2] - 1) // p[3] for p in plan) == len(rooms)


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        x = rng.integers(0, 50257, n).astype(np.uint32) if n % 2 else rng.integers(0, 9, n).astype(np.uint32)
        image = op6_token_files.write_image([1, None], [n, 0], x)
        ids, lengths, wm = op6_token_files.read_image(image)
        assert ids == [1, None] and lengths.tolist() == [n, 0] and (wm.tokens() == x).all()
        for i in range(0, n, 97):
            t = int(x[i])
            assert wm.access(i) == t and wm.rank(t, i) == int((x[:i] == t).sum())
            assert wm.count(t) == int((x == t).sum()) and wm.locate(t)[:50] == np.flatnonzero(x == t)[:50].tolist()
        assert wm.count(60000) == 0


def test_planes_are_unpacked_one_by_one(monkeypatch):
    x = np.arange(3000, dtype=np.uint32) % 700 + 1024
    image = op6_token_files.write_image([1], [3000], x)
    unpacked = []
    real = op6_token_files.zstandard.ZstdDecompressor
    monkeypatch.setattr(op6_token_files.zstandard, "ZstdDecompressor", lambda: unpacked.append(1) or real())
    _, _, wm = op6_token_files.read_image(image)
    assert len(unpacked) == 3  # ids, their nulls, lengths
    assert wm.count(1) == 0 and len(unpacked) == 5  # the first plane and its counts rule the token out
    assert wm.count(1029) == 5 and len(unpacked) == 3 + 2 * wm.bits
    assert wm.locate(1029) == [5, 705, 1405, 2105, 2805] and len(unpacked) == 3 + 2 * wm.bits


def test_token_files(spark, odd, tmp_path):
    tok = Tokenizer.from_file(BYTES)
    for k, docs in enumerate((odd, _small(spark))):
        rows = docs.selectExpr("*", "xxhash64(text) h").collect()
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "", r.doc_id) for r in rows), key=lambda r: r[:3])
        want, at = [], 0
        for *_, text, doc in rows:
            ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        op6_token_files.write_token_files(docs, BYTES, str(tmp_path / f"t{k}"), shard_tokens=2000)
        got = op6_token_files.read_token_files(str(tmp_path / f"t{k}"), docs)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert op6_token_files.export(str(tmp_path / f"t{k}"), docs, str(tmp_path / f"x{k}")) > 1
    assert op6_token_files.token_files(odd.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_every_character_in_context(path):
    """Each character of the basic plane, beside letters, digits, marks and spaces, against the library."""
    proof = prove(read_vocabulary(path))
    tok, enc = Tokenizer.from_file(path), Encoder(proof)
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)} .{chr(c)}\n{chr(c)} " for c in range(k, k + 16)) for k in range(0, 0x3400, 16)]
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
