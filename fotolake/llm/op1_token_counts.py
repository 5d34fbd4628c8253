"""Token counts by the whole-token shortcut.

Offline, on the driver, ``whole_strings`` finds which strings of the vocabulary encode alone as one token, and
``prove`` for which characters Python's own pattern splits as the tokenizer's does.  Executors then count
pre-tokens that are such strings directly, and merge only the rest (distinct ones, many at once).
A text that holds another character, or the string of an added token, goes through the library whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); null ids are kept; repeated rows give
repeated rows; extra columns are ignored; long texts are worked on in blocks of about a million
characters, so that memory follows the block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fotolake.llm.common import pick
from fotolake.llm.tokens import SPLITS, Proof, encoder, library, prove, read_vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
LIMIT = 512
_WHOLE: dict[str, frozenset[str]] = {}


def whole_strings(proof: Proof) -> frozenset[str]:
    """Strings of the vocabulary that alone are one pre-token and one token."""
    vocabulary, kind, *_ = proof
    key = hashlib.md5(vocabulary.encode()).hexdigest()
    if kind == "other":
        return frozenset()
    if key not in _WHOLE:
        tok = library(vocabulary)
        added = {a["content"] for a in json.loads(vocabulary).get("added_tokens", [])}
        ids = [i for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in added]
        strings = [s for s in tok.decode_batch([[i] for i in ids], skip_special_tokens=False) if s and "\ufffd" not in s]
        _WHOLE[key] = frozenset(
            s for s, e in zip(strings, tok.encode_batch_fast(strings, add_special_tokens=False), strict=True)
            if len(e.ids) == 1 and SPLITS[kind].findall(s) == [s] and not any(a in s for a in added)
        )
    return _WHOLE[key]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens, for every row of docs."""
    proof = prove(read_vocabulary(vocabulary_path))
    sent = docs.sparkSession.sparkContext.broadcast((proof, whole_strings(proof)))  # as large as the vocabulary file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(*sent.value).count
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            n = pa.array(count(t.as_py() for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), sizes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, "doc_id", "text").mapInArrow(work, SCHEMA)
