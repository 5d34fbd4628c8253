"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base patterns, addresses written out ("name at
host dot org") and telephone numbers without a country code.  Base spans that pass their checks stay.  For the
others, boosted trees score format and context; they are fitted on counts of feature patterns (2 ** features for each
kind at most).  No candidate of these two generators is labelled by its own pattern.  Positives are checked
base spans written anew in the other format, where they stand: an e-mail address written out, a telephone number without
its country code, each with the neighbours that the original has.  Negatives are the same formats made of ordinary
words, or of a made-up number, between ordinary words of texts without any checked span; and candidates that
overlap a checked span of another kind or touch a letter or digit.  Every second document (by hash) is held out to
calibrate a threshold for each kind: scores are tested from the highest down as a fixed sequence, and the lowest stays
up to which precision on the held-out candidates has an exact lower bound of at least ``precision``; without
enough evidence a kind adds nothing.

Positions are code points.  Patterns run in time and stack linear in the text or less: a run of characters is tried
once, from its start or from the end of the match before, and repeated groups are possessive.

Defined cases: a null text is empty; very long texts and matches are worked on like others; texts without candidates
have counts 0 and no spans; repeated rows, and rows of one id or without one, are worked on each on its own; spans of
one kind never overlap; no documents give no rows; extra columns are ignored, whatever their names (redact keeps them).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import materialize, pick
from fotolake.llm.op9_quality_rules import least_trials, upper_bound_holds

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
#: (name, kind, base?, what a text must contain, pattern)
GENERATORS = (
    ("email", "email", True, "@", _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", "card", True, "[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email_words", "email", False, r"\b(?i:dot)\b", _LOCAL + r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}"),
    ("phone_local", "phone", False, "[0-9]{4}", r"(?:\G|(?<![0-9]))\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
BASE = {g[0]: g[2] for g in GENERATORS}
KIND = {g[0]: g[1] for g in GENERATORS}
ROUNDS, RATE, PRECISION, RISK = 30, 0.3, 0.95, 0.01
FEATURES = 14


def features(m: Column, left: Column, right: Column) -> Column:
    """A bit for each feature of a candidate: its text and what stands before and after."""
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    tests = (
        right.rlike("^[A-Za-z0-9]"),
        left.rlike(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|ring|text)\b\W*$"),
        left.rlike(r"(?i)\b(?:card|visa|account|mail|e-?mail|ip|addr(?:ess)?|host|server|write|reach)\b\W*$"),
        left.rlike(r"[0-9][\x20.,-]?$"),
        left.rlike(r"[=#\"'$_/:]\s?$"),
        m.contains(" "), m.contains("-"), m.contains("."), m.contains("("),
        digits >= 10, m.rlike("[A-Za-z]"), left.rlike(r"[A-Za-z]$"),
        m.rlike(r"^[A-Za-z]*[0-9._%+-]"), m.rlike(r"[0-9-]\x20?[(\[]?[Dd][Oo][Tt]|[)\]]"),
    )
    mask = F.lit(0)
    for i, t in enumerate(tests):
        mask = mask + F.when(t, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def passes(name: str, m: Column) -> Column:
    """The check of a base pattern."""
    if name == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if name == "card":
        digits = F.translate(m, " -", "")
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if name == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(name == "email")


def _met(text: Column, needs: str, pattern: str) -> tuple[Column, Column]:
    """Matches, and the texts between them; none where a text can't have a match."""
    may = text.contains(needs) if needs == "@" else text.rlike(needs)
    none = F.array().cast("array<string>")
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(may, F.split(text, pattern)).otherwise(none)


def _describe(name: str):
    def of(x: Column, i: Column) -> Column:
        m = x["m"]
        return F.struct(
            F.lit(name).alias("gen"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(m).alias("len"),
            passes(name, m).alias("ok"), features(m, F.right(x["g"], F.lit(16)), F.left(x["n"], F.lit(2))).alias("mask"),
        )

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id and each proposed span (gen, start, stop, ok, mask); once with nulls where there is none."""
    df = pick(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for name, _, _, needs, pattern in GENERATORS:
        m, g = _met(F.col("text"), needs, pattern)
        df = df.withColumn(f"m_{name}", m).withColumn(f"g_{name}", g)
    every = []
    for name, *_ in GENERATORS:
        m, g = F.col(f"m_{name}"), F.col(f"g_{name}")
        zipped = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("n"))
        every.append(F.transform(zipped, _describe(name)))
    rows = df.select("row", "doc_id", F.explode_outer(F.concat(*every)).alias("x")).select("row", "doc_id", "x.*").repartition("row")
    upto = Window.partitionBy("row", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("len")).over(upto)
    return rows.withColumn("stop", stop.cast("long")).select("row", "doc_id", "gen", (F.col("stop") - F.col("len")).alias("start"), "stop", "ok", "mask")


def judged(spans: DataFrame) -> DataFrame:
    """Candidates with kind, ``base`` (stays), ``inside`` a base span of the kind, and ``clash`` with any base span."""
    kind = F.element_at(F.create_map(*[F.lit(x) for n, k in KIND.items() for x in (n, k)]), F.col("gen"))
    base = F.col("ok") & F.col("gen").isin([n for n, b in BASE.items() if b])
    df = spans.withColumn("kind", F.when(F.col("gen").isNotNull(), kind)).withColumn("base", F.coalesce(base, F.lit(False)))
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    mine_before = Window.partitionBy("row", "kind").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("base"), F.col("stop"))
    start = F.when(F.col("base"), F.col("start"))
    same_start = Window.partitionBy("row", "kind", "start")
    return df.select(
        "*",
        (F.coalesce(F.max(end).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(start).over(after) < F.col("stop"), F.lit(False))).alias("clash"),
        (F.coalesce(F.max(end).over(mine_before) >= F.col("stop"), F.lit(False)) | F.coalesce(F.max(end).over(same_start) >= F.col("stop"), F.lit(False))).alias("inside"),
    )


class Trees:
    """Boosted trees of depth two on feature bits, for each kind; thresholds are calibrated scores."""

    def __init__(self, trees: dict[str, tuple[float, list]], limits: dict[str, float]):
        self.trees, self.limits = trees, limits

    @staticmethod
    def _fit(masks: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, list]:
        bits = (masks[:, None] >> np.arange(FEATURES)) & 1 == 1
        total = pos + neg
        first = math.log((pos.sum() + 1) / (neg.sum() + 1))
        score = np.full(len(masks), first)
        trees = []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            grad, hess = pos - total * p, total * p * (1 - p)
            gain = lambda at: grad[at].sum() ** 2 / (hess[at].sum() + 1.0)
            best = max(range(FEATURES), key=lambda f: gain(bits[:, f]) + gain(~bits[:, f]))
            leaves = []
            for side in (False, True):
                at = bits[:, best] == side
                sub = max(range(FEATURES), key=lambda f: gain(at & bits[:, f]) + gain(at & ~bits[:, f]))
                for low in (False, True):
                    leaf = at & (bits[:, sub] == low)
                    step = RATE * grad[leaf].sum() / (hess[leaf].sum() + 1.0)
                    score[leaf] += step
                    leaves.append((sub, round(float(step), 6)))
            trees.append((best, leaves[0][0], leaves[0][1], leaves[1][1], leaves[2][0], leaves[2][1], leaves[3][1]))
        return round(first, 6), trees

    @staticmethod
    def score_masks(model: tuple[float, list], masks: np.ndarray) -> np.ndarray:
        out = np.full(len(masks), model[0])
        bit = lambda f: (masks >> f) & 1 == 1
        for f, a, a0, a1, b, b0, b1 in model[1]:
            out += np.where(bit(f), np.where(bit(b), b1, b0), np.where(bit(a), a1, a0))
        return out

    @classmethod
    def fit(cls, counts: list, precision: float = PRECISION, risk: float = RISK) -> Trees:
        """counts: (kind, mask, held, positive, negative) rows."""
        trees, limits = {}, {}
        for kind in KINDS:
            own = [r for r in counts if r[0] == kind]
            if not (sum(r[3] for r in own) and sum(r[4] for r in own)):
                continue
            train, held = [r for r in own if not r[2]], [r for r in own if r[2]]
            if not train or not held:
                continue
            cols = np.array([r[1:] for r in train], dtype=np.float64)
            model = cls._fit(cols[:, 0].astype(np.int64), cols[:, 2], cols[:, 3])
            marks = cls.score_masks(model, np.array([r[1] for r in held], dtype=np.int64))
            levels = sorted(set(marks.round(6)))
            for limit in reversed(levels):  # a fixed sequence: the first level that fails ends it
                up = marks.round(6) >= limit
                p = int(sum(r[3] for r, u in zip(held, up, strict=True) if u))
                n = int(sum(r[4] for r, u in zip(held, up, strict=True) if u))
                if upper_bound_holds(n, p + n, 1 - precision, risk):
                    trees[kind], limits[kind] = model, float(limit) - 1e-6
                elif p + n >= least_trials(1 - precision, risk):  # so few can't show anything yet
                    break
        return cls(trees, limits)

    def accepts(self, kind: str, mask: Column) -> Column:
        if kind not in self.trees:
            return F.lit(False)
        first, trees = self.trees[kind]
        bit = lambda f: mask.bitwiseAND(F.lit(1 << f)) != 0
        total = F.lit(first)
        for f, a, a0, a1, b, b0, b1 in trees:
            total = total + F.when(bit(f), F.when(bit(b), F.lit(b1)).otherwise(F.lit(b0))).otherwise(F.when(bit(a), F.lit(a1)).otherwise(F.lit(a0)))
        return total >= F.lit(self.limits[kind])


ORDINARY = r"^(.*?[A-Za-z] )([A-Za-z]{2,})( [A-Za-z]{2,} )([A-Za-z]{2,})( [A-Za-z]{2,} )([A-Za-z]{2,})( [A-Za-z].)"


def evidence(docs: DataFrame) -> DataFrame:
    """doc_id, kind, mask, made (true: personal): labelled views of formats, whatever their own patterns match in a text.

    A text with checked addresses or numbers gives each of them in the other format; a text without gives its first
    seven words in a row, if there are so many, as ordinary surroundings.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.pmod(F.xxhash64("text"), F.lit(3)).alias("form"))
    pattern = {g[0]: (g[3], g[4]) for g in GENERATORS}
    parts = {}
    for name in ("email", "phone"):
        m, g = _met(F.col("text"), *pattern[name])
        df = df.withColumn(f"m_{name}", m).withColumn(f"g_{name}", g)
        m, g = F.col(f"m_{name}"), F.col(f"g_{name}")
        parts[name] = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("n"))
    form = F.col("form")
    at = F.when(form == 0, " at ").when(form == 1, "(at)").otherwise(" [at] ")
    dot = F.when(form == 0, " dot ").when(form == 1, "(dot)").otherwise(" [dot] ")

    def view(kind: str, m: Column, left: Column, right: Column, made: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), features(m, F.right(left, F.lit(16)), F.left(right, F.lit(2))).alias("mask"), F.lit(made).alias("made"))

    def written_out(x: Column) -> Column:
        name, host = F.substring_index(x["m"], "@", 1), F.substring_index(x["m"], "@", -1)
        last = F.substring_index(host, ".", -1)
        return view("email", F.concat(name, at, F.left(host, F.length(host) - F.length(last) - 1), dot, last), x["g"], x["n"], True)

    national = r"^\+[0-9]{1,3}[\x20.-]?(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})$"
    numbers = F.filter(parts["phone"], lambda x: passes("phone", x["m"]) & x["m"].rlike(national))
    known = F.concat(F.transform(parts["email"], written_out), F.transform(numbers, lambda x: view("phone", F.regexp_extract(x["m"], national, 1), x["g"], x["n"], True)))
    plain = [F.regexp_extract(F.left("text", F.lit(1000)), ORDINARY, k) for k in range(1, 8)]
    number = F.when(form == 0, "415-555-0100").when(form == 1, "(415) 555-0100").otherwise("415.555.0100")
    email = F.concat(plain[1], at, plain[3], dot, plain[5])
    ordinary = F.when(plain[1] != "", F.array(view("email", email, plain[0], plain[6], False), view("phone", number, plain[0], plain[6], False)))
    rows = F.explode(F.when(F.size(known) > 0, known).otherwise(ordinary)).alias("x")
    return df.select("doc_id", rows).select("doc_id", "x.*")


def fit(known: DataFrame, docs: DataFrame) -> Trees:
    """Trees from evidence and from judged candidates.  Every second document (by hash) is held out for calibration."""
    touches = F.col("mask").bitwiseAND(F.lit(1)) != 0
    wrong = known.where(~F.col("gen").isin([n for n, b in BASE.items() if b]) & ~F.col("inside") & (F.col("clash") | touches))
    views = evidence(docs).unionByName(wrong.select("doc_id", "kind", "mask", F.lit(False).alias("made")))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    counts = (
        views.groupBy("kind", "mask", held.alias("held"))
        .agg(F.sum(F.col("made").cast("long")).alias("p"), F.sum((~F.col("made")).cast("long")).alias("n"))
        .collect()  # at most 4 kinds x 2 ** FEATURES x 2 rows
    )
    return Trees.fit(sorted(tuple(r) for r in counts))


def selected(known: DataFrame, model: Trees) -> DataFrame:
    extra = F.lit(False)
    for name, kind in KIND.items():
        if not BASE[name]:
            extra = extra | ((F.col("gen") == name) & model.accepts(kind, F.col("mask")))
    return known.withColumn("extra", F.coalesce(extra & ~F.col("clash"), F.lit(False)))


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of base spans and all spans, for every row of docs."""
    known = materialize(judged(candidates(docs)), "pii")
    chosen = selected(known, fit(known, docs))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(order.alias("o"), "start", "stop", "base")
    rows = chosen.groupBy("row", "doc_id").agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base") | F.col("extra"), span))).alias("spans"),
    )
    named = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["o"].cast("int")), x["start"].cast("string"), x["stop"].cast("string"))
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["base"]), named), ",")
    return rows.select(
        "doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"), F.array_join(F.transform("spans", named), ",").alias("spans"),
    )


def train(docs: DataFrame) -> Trees:
    return fit(judged(candidates(docs)), docs)


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with the spans that the report selects replaced by their kind in brackets, without a shuffle.

    All spans are found in the original text.  Overlapping ones are replaced as one, named by the longest of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs
    for name, _, _, needs, pattern in GENERATORS:
        m, g = _met(text, needs, pattern)
        df = df.withColumn(f"_m_{name}", m).withColumn(f"_g_{name}", g)
    found = {name: _selected_in_row(name, kind, base, model) for name, kind, base, *_ in GENERATORS}
    df = df.withColumn("_base", F.concat(*[found[n] for n in found if BASE[n]]))
    clear = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    df = df.withColumn("_spans", F.array_sort(F.concat("_base", *[F.filter(found[n], clear) for n in found if not BASE[n]])))
    df = df.withColumn("_spans", F.aggregate("_spans", F.array().cast(f"array<{SPAN}>"), _merged))
    parts = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.struct(
            x["stop"].alias("at"),
            F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return df.withColumn("text", F.when(F.size("_spans") > 0, parts).otherwise(F.col("text"))).select(*docs.columns)


SPAN = "struct<start:int,stop:int,long:int,kind:string>"


def _selected_in_row(name: str, kind: str, base: bool, model: Trees) -> Column:
    """The spans of a generator that are selected by themselves, of a row with its matches."""
    m, g = F.col(f"_m_{name}"), F.col(f"_g_{name}")
    zipped = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["m"])
        gone = passes(name, x["m"]) if base else model.accepts(kind, features(x["m"], F.right(x["g"], F.lit(16)), F.left(x["n"], F.lit(2))))
        span = F.struct(start.alias("start"), stop.alias("stop"), F.length(x["m"]).alias("long"), F.lit(kind).alias("kind"))
        return F.struct(stop.alias("at"), F.when(gone, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.aggregate(zipped, first, step, lambda acc: acc["spans"])


def _merged(acc: Column, x: Column) -> Column:
    """The spans so far and the next: one that begins within the last is joined to it."""
    last = F.get(acc, F.size(acc) - 1)
    both = F.struct(
        last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"), F.greatest(last["long"], x["long"]).alias("long"),
        F.when(x["long"] > last["long"], x["kind"]).otherwise(last["kind"]).alias("kind"),
    )
    meets = F.coalesce(x["start"] < last["stop"], F.lit(False))
    return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(x)))
