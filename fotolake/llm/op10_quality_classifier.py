"""Quality classifier: a weak-label model trains a hashed linear scorer.

Kinds of bad text (four of junk, and toxic) are told apart, each by overlapping heuristic labellers that vote
bad, good or abstain.  Votes of all documents are counted by pattern (3 ** labellers patterns a kind at most);
expectation-maximisation on these counts estimates, for each kind, how often each labeller votes what for good
and for bad texts, and gives every pattern the probability of being bad.  Annotators' toxic labels, where a
document has one, are one more labeller of that kind, whose accuracy is given; quality labels are not used at all.  These posterior labels train a linear
scorer on hashed features (words, beginnings of words, shares), on a sample of at most ``sample`` documents, annotated ones first, then those with
the lowest hash (the bound is a parameter; votes, EM and scores cover all documents).  Hash buckets are counted
where the sample lies; those that don't tell good from bad clearly get no weight, so a long text is not judged by noise.
The lists of insults are general ones in four languages and only vote; the scorer judges, with what the annotators' labels teach.
A document is kept if both scores are below one half.

Defined cases: a null or empty text has no words, gets the votes of no evidence and is scored like any other; very long
texts are scored whole; repeated rows are scored each; no documents give no rows; null ids are kept; of several labels of
a document the worst counts; without labels the lists alone teach what is toxic; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import drop_scratch, materialize, own_caches, pick, trim
from fotolake.llm.hashes import part_hashes

SAMPLE, BITS, ROUNDS, STEP, CLEAR = 20_000, 20, 200, 1.5, 5
#: The most buckets that a scorer weighs: those that tell most.  Pairs of a text and a bucket that are worked on at once.
WEIGHED, PAIRS = 4096, 1 << 19
#: Lengths in bytes of beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Common insults in English, German, French and Spanish, in three lists that labellers use.
INSULTS = (
    "idiot moron imbecile fool dunce stupid dumb dimwit halfwit clown trottel dummkopf depp blödmann schwachkopf vollidiot dumm imbécile crétin débile abruti idiota imbécil tonto estúpido payaso burro",
    "trash garbage scum filth vermin loser parasite dreck abschaum müll ratte schwein versager parasit ordure déchet racaille vermine raté basura escoria mugre cerdo perdedor parásito",
    "pathetic disgusting worthless useless ugly hateful revolting nasty erbärmlich widerlich wertlos ekelhaft nutzlos hässlich pathétique dégoûtant minable répugnant affreux patético asqueroso inútil repugnante despreciable",
)
_LISTS = tuple(frozenset(x.encode().split()) for x in INSULTS)
_EVERY = frozenset().union(*_LISTS)
_STRIP = b".,;:!?\"'()[]*%$&#|<>"
#: Classes of bytes: 1 small letters and what isn't ASCII, 2 capitals, 3 symbols, 4 !, 5 |.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[list(b"#*$%&<>")] = 3
_CLASS[33], _CLASS[124] = 4, 5
#: Kinds of bad text and their labellers; votes are digits to the base of 3 in this order.
KINDS = (("symbols", 3), ("capitals", 3), ("repeats", 3), ("tables", 3), ("toxic", 5))


def _vote(x: float, bad: float, good: float, above: bool = True) -> int:
    """2 bad, 1 good, 0 abstain."""
    if not above:
        x, bad, good = -x, -bad, -good
    return 2 if x > bad else 1 if x < good else 0


def describe(raw: bytes) -> tuple[int, list[bytes]]:
    """All votes as one number, and features other than words."""
    chars = np.frombuffer(raw, np.uint8)
    kind = _CLASS[chars]
    kinds = np.bincount(kind, minlength=6).tolist()
    tokens = raw.lower().split()
    n, letters = max(1, len(tokens)), max(1, kinds[1] + kinds[2])
    distinct = set(tokens)
    top = max(Counter(tokens).values()) / n if n >= 20 and len(distinct) < 0.5 * n else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    shares = (
        (kinds[3] / letters, 0.03, 0.01, True),
        (int(((kind[:-1] == 3) & (chars[1:] <= 32)).sum()) / n, 0.3, 0.05, True),
        (sum(x in raw for x in (b"#", b"*", b"$", b"%", b"&")) / 5, 0.7, 0.3, True),
        (kinds[2] / letters, 0.5, 0.2, True),
        (int(((kind[:-1] == 2) & (kind[1:] == 2)).sum()) / letters, 0.3, 0.05, True),
        (kinds[4] / n, 0.3, 0.05, True),
        (len(distinct) / n if n >= 20 else 0.425, 0.35, 0.5, False),
        (top, 0.2, 0.1, True),
        (1 - len(set(lines)) / m if m > 2 else 0.0, 0.3, 0.1, True),
        (kinds[5] / n, 0.15, 0.02, True),
        (tokens.count(b"|") / n, 0.15, 0.02, True),
        (sum(b" | " in x for x in lines) / m, 0.6, 0.1, True),
    )
    votes = 0
    features = []
    for k, (x, bad, good, above) in enumerate(shares):
        votes = votes * 3 + _vote(x, bad, good, above)
        features.append(b"\x00share %d %d" % (k, min(20, int(x * 20))))
    hits = {w.strip(_STRIP) for w in distinct} & _EVERY
    # No insult of these lists says nothing about other languages, so these labellers never vote good.
    for part in _LISTS:
        votes = votes * 3 + (2 if hits.intersection(part) else 0)
    votes = votes * 3 + (2 if len(hits) >= 2 else 0)
    votes *= 3  # the place of the annotators' vote
    return votes, features


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[48:58] = _LETTER[128:] = True


def word_buckets(raws: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text the hash buckets of its words and of their beginnings, ascending; for many texts at once."""
    raw = b"\n".join([*raws, b""]).lower()
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_LETTER[b].view(np.int8), prepend=np.int8(0)))
    start, stop = edge[::2], edge[1::2]
    size = stop - start
    every = [part_hashes(raw, b, start, stop)]
    for k in BEGINNINGS:
        # Shorter words have no such beginning: their word stands for it once more.
        every.append(np.where(size > k, part_hashes(raw, b, start, np.minimum(start + k, stop)) ^ np.uint64(0xA5A5A5A5A5A5A5A5), every[0]))
    found = [((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32) for x in every]
    cut = np.searchsorted(start, np.r_[0, np.cumsum([len(x) + 1 for x in raws])]).tolist()
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        x = np.sort(np.concatenate([f[a:z] for f in found]))
        yield x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def described(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """The votes and the buckets of each text."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        for raw, x in zip(held, word_buckets(held) if held else (), strict=True):
            votes, features = describe(raw)
            yield votes, np.unique(np.r_[x, [xxhash.xxh64_intdigest(f) >> (64 - BITS) for f in features]]).astype(np.int32)

    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > 1 << 20:
            yield from flush()
            held, size = [], 0
    yield from flush()


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_caches("quality")
    for b in batches:
        votes = [describe((t.as_py() or "").encode("utf-8", "surrogatepass"))[0] for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes, pa.int64())], ["doc_id", "h", "votes"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_caches("quality")
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            x = [zlib.compress(np.diff(x, prepend=np.int32(0)).astype("<i4").tobytes(), 1) for _, x in described(t.as_py() for t in part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], ["h", "x"])


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), "<i4"), dtype=np.int32)


def digits() -> dict[str, tuple[int, int]]:
    """For each kind, what to divide votes by and the number of its patterns."""
    out, below = {}, 1
    for kind, k in reversed(KINDS):
        out[kind] = below, 3**k
        below *= 3**k
    return out


def fit_labels(counts: dict[int, int], labellers: int, anchored: bool = False, rounds: int = 100) -> dict[int, float]:
    """Expectation-maximisation over vote patterns: the probability of bad for each pattern.

    anchored: the last labeller is an annotator, whose votes are taken as right in 99 of 100 cases.
    """
    if not counts:
        return {}
    codes = sorted(counts)
    votes = np.array([[c // 3**k % 3 for k in range(labellers - 1, -1, -1)] for c in codes])
    weight = np.array([counts[c] for c in codes], float)
    # At first a vote is taken as right in eight of ten cases, and one text in ten as bad.
    rates = np.full((2, labellers, 3), 0.1)
    rates[0, :, 1] = rates[1, :, 2] = 0.8
    prior = 0.1
    bad = np.zeros(len(codes))
    for _ in range(rounds):
        logs = [np.log(rates[c][np.arange(labellers), votes]).sum(axis=1) for c in (0, 1)]
        gap = logs[1] + math.log(prior) - logs[0] - math.log(1 - prior)
        bad = 1 / (1 + np.exp(-np.clip(gap, -50, 50)))
        if anchored:
            bad = np.choose(votes[:, -1], [bad, np.minimum(bad, 0.01), np.maximum(bad, 0.99)])
        for c, share in ((0, 1 - bad), (1, bad)):
            own = weight * share
            for v in range(3):
                # One made-up vote of each kind keeps rates off 0; good votes for good texts stay likelier.
                rates[c, :, v] = (own[:, None] * (votes == v)).sum(axis=0) + (8 if v == 1 + c else 1) * 0.5
            rates[c] /= rates[c].sum(axis=1, keepdims=True)
        prior = min(0.5, max(1e-4, float((weight * bad).sum() / weight.sum())))
    return {c: round(float(p), 9) for c, p in zip(codes, bad, strict=True)}


#: Shares are counted in millionths, so that sums don't depend on their order.
UNIT = 1_000_000
COUNTS = "bucket int, kind int, n long, bad long"


def _counted(targets_of: Callable[[int], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each bucket is there in a task's part of the sample, by kind: in all, and in bad texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        bad = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for votes, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                at = unpacked(x.as_py())
                for k, (share, trust) in enumerate(targets_of(votes)):
                    n[k, at] += round(UNIT * trust)
                    bad[k, at] += round(UNIT * trust * share)
        kind, bucket = np.nonzero(n)
        for at in range(0, len(kind), 100_000):
            k, i = kind[at : at + 100_000], bucket[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(n[k, i]), pa.array(bad[k, i])], ["bucket", "kind", "n", "bad"])

    return work


def telling(n: np.ndarray, bad: np.ndarray, mean: float) -> np.ndarray:
    """Which buckets tell good from bad: whose share of bad differs clearly from the mean.  n, bad: by bucket, as shares."""
    z = (bad - n * mean) / np.sqrt(n * mean * (1 - mean) + 1.0)
    return (np.abs(z) > CLEAR) & (n >= 5)


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, trust: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights of hash buckets, and the offset, by logistic regression on the buckets ``use`` (ascending; none: all that tell).

    trust: how much a row counts.
    """
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    mean = float(np.clip(np.average(target, weights=trust) if len(target) else 0.0, 1e-4, 1 - 1e-4))
    if not len(rows):
        return weights, math.log(mean / (1 - mean))
    if use is None:
        flat, of = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        use = np.flatnonzero(telling(np.bincount(flat, weights=trust[of], minlength=size), np.bincount(flat, weights=(trust * target)[of], minlength=size), mean))
    place = np.full(size, -1, np.int32)
    place[use] = np.arange(len(use))
    cols = [c[c >= 0] for c in (place[r] for r in rows)]
    col, row = np.concatenate(cols), np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in cols])
    del cols
    parts = [slice(at, at + PAIRS) for at in range(0, len(col), PAIRS)]  # so that what is made on the way stays small
    k = len(use)

    def by_row(w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(row[x], weights=w[col[x]], minlength=len(rows)) for x in parts), np.zeros(len(rows)))

    def by_bucket(v: np.ndarray) -> np.ndarray:
        return sum((np.bincount(col[x], weights=v[row[x]], minlength=k) for x in parts), np.zeros(k))

    w, bias, speed_w, speed_b = np.zeros(k), math.log(mean / (1 - mean)), np.zeros(k), 0.0
    # Each class counts the same in all, so that a rare kind is learned as well.
    balance = trust * np.where(target > 0.5, 0.5 / mean, 0.5 / (1 - mean))
    support = by_bucket(balance) + 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(by_row(w) + bias, -50, 50)))
        err = balance * (target - p)
        speed_w = 0.8 * speed_w + 0.3 * (by_bucket(err) - 0.05 * w) / support * STEP
        speed_b = 0.8 * speed_b + 0.3 * err.sum() / balance.sum()
        w += speed_w / 4
        bias += speed_b
    weights[use] = w
    return weights, float(bias)


class Model:
    def __init__(self, junk: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float]):
        self.weights = np.stack([junk[0], toxic[0]])
        self.bias = np.array([junk[1], toxic[1]])

    def score(self, x: np.ndarray) -> tuple[float, float]:
        s = self.weights[:, x].sum(axis=1, dtype=np.float64) + self.bias
        a, b = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
        return round(float(a), 6), round(float(b), 6)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    base = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    told = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.when(F.max("toxic") > 0, 2).otherwise(1).alias("told"))
    voted = base.mapInArrow(_patterns, "doc_id long, h long, votes long").join(told, "doc_id", "left")
    voted = materialize(voted.select("h", (F.col("votes") + F.coalesce("told", F.lit(0))).alias("votes"), F.col("told").isNull().alias("untold")), "votes")
    posterior = {}
    for kind, k in KINDS:
        below, size = digits()[kind]
        pattern = F.expr(f"votes div {below} % {size}")
        posterior[kind] = fit_labels({r[0]: r[1] for r in voted.groupBy(pattern).count().collect()}, k, kind == "toxic")  # 3 ** k rows at most
    chosen = voted.groupBy("h").agg(F.max("votes").alias("votes"), F.min("untold").alias("untold")).orderBy("untold", "h").limit(sample)
    chosen = materialize(chosen.select("h", "votes"), "sample")
    found = base.join(F.broadcast(chosen.select("h")), "h", "left_semi").select("h", "text").mapInArrow(_featured, "h long, x binary").dropDuplicates(["h"])
    featured = materialize(found.join(chosen, "h").select("h", "votes", "x"), "featured")
    sums = featured.mapInArrow(_counted(lambda votes: trusted(votes, posterior)), COUNTS).groupBy("bucket", "kind").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    told_all = {r.votes: r["count"] for r in featured.groupBy("votes").count().collect()}  # vote patterns
    means = []
    for k in (0, 1):
        total = sum(c * trusted(v, posterior)[k][1] for v, c in told_all.items())
        means.append(float(np.clip(sum(c * math.prod(trusted(v, posterior)[k]) for v, c in told_all.items()) / max(total, 1e-9), 1e-4, 1 - 1e-4)))
    mean = F.when(F.col("kind") == 0, means[0]).otherwise(means[1])
    n, bad = F.col("n") / UNIT, F.col("bad") / UNIT
    z = F.abs(bad - n * mean) / F.sqrt(n * mean * (1 - mean) + 1.0)
    best = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("z"), "bucket"))
    clear = sums.withColumn("z", z).where((n >= 5) & (F.col("z") > CLEAR)).withColumn("best", best).where(F.col("best") <= WEIGHED)
    clear = clear.select("bucket", "kind").collect()  # 2 * WEIGHED rows at most
    use = [np.array(sorted(r.bucket for r in clear if r.kind == k), np.int64) for k in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast(np.union1d(*use).astype(np.int32))
    # ``sample`` rows at most, with the buckets that are used.
    rows = featured.mapInArrow(_with(sent), "h long, votes long, x binary").orderBy("h").collect()
    for done in (voted, chosen, featured):
        drop_scratch(done)
    xs = [np.frombuffer(r.x, "<i4") for r in rows]
    labels_of = np.array([trusted(r.votes, posterior) for r in rows]).reshape(-1, 2, 2)
    del rows
    trim()
    return Model(*(fit_scorer(xs, labels_of[:, k, 0], labels_of[:, k, 1], use[k]) for k in (0, 1)))


def _with(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.intersect1d(unpacked(v.as_py()), sent.value, True).astype("<i4").tobytes() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], ["h", "votes", "x"])

    return work


def trusted(votes: int, posterior: dict[str, dict[int, float]]) -> tuple[tuple[float, float], tuple[float, float]]:
    """For junk and for toxic: the probability, and how much the row counts.

    Without any vote a row hardly says anything of toxicity; it serves where nothing else does.
    """
    junk, toxic = targets(votes, posterior)
    return (junk, 1.0), (toxic, 1.0 if votes % digits()["toxic"][1] else 0.02)


def targets(votes: int, posterior: dict[str, dict[int, float]]) -> tuple[float, float]:
    """The probabilities of junk (of any kind) and of toxic."""
    p = {kind: posterior[kind][votes // below % size] for kind, (below, size) in digits().items()}
    clean = 1.0
    for kind, x in p.items():
        if kind != "toxic":
            clean *= 1 - x
    return 1 - clean, p["toxic"]


SCORES = "junk_score double, toxic_score double, kept boolean"


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, junk_score, toxic_score, kept for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # 8 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("quality")
        for b in batches:
            got = [sent.value.score(x) for _, x in described(t.as_py() for t in b.column(1))]
            cols = [pa.array([x[i] for x in got], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols, pa.array([max(x) < 0.5 for x in got], pa.bool_())], ["doc_id", "junk_score", "toxic_score", "kept"])

    return pick(docs, "doc_id", "text").mapInArrow(work, f"doc_id long, {SCORES}")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_caches("quality")
        for b in batches:
            yield b.filter(pa.array([max(sent.value.score(x)) < 0.5 for _, x in described(t.as_py() for t in b.column(at))], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
