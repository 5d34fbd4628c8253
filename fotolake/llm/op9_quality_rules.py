"""Quality rules with risk-controlled cutoffs, with DataFrame functions only.

Counts are taken once for every text.  Each rule rejects a text whose share of something is above a cutoff.
Cutoffs come from labelled good documents, for each stratum (language) on its own.  One half of them (by hash of the id)
proposes a path of ever stricter settings: at each step every rule takes the lowest cutoff of a fixed grid that rejects
at most the step's share of that half.  The other half, the holdout, tests the steps one after another: a step holds
while the exact binomial upper bound of the rate of good documents that all rules together reject is at most ``alpha``,
at confidence 1 - ``delta`` / strata.  The first step that fails ends the test, so the steps need no correction (a fixed
sequence of nested hypotheses) and the strata have Bonferroni's.  With confidence 1 - delta no stratum loses more
than ``alpha`` of its good documents.  A stratum with too few labels for any promise rejects nothing by these rules.

Defined cases: a null or blank text has no words and fails the base rule; very long texts are worked on in linear time;
a null language is a stratum of its own; a document counts as one trial however often its id repeats, with its
highest shares; with several labels it is good only if all say so; null labels are left out; repeated
rows are kept; no labels: nothing but the base rule; no documents give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import materialize, pick, small_table
from fotolake.llm.windows import hash_pair, join_shifted

SPACE = r"[\x20\x09-\x0D]+"
ALPHA, DELTA = 0.05, 0.05
#: The share of good documents that each rule may reject in the proposing half, step by step.
STEPS = (0.0, 0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02)
#: Cutoffs that are tried, in thousandths.
GRID = (5, 10, 15, 20, 30, 40, 50, 75, 100, 125, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
#: Rules: share of numerator in denominator, in thousandths.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
}


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = pick(docs, "doc_id", "text", *keep).select(
        "doc_id", *keep,
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
    )
    done = [*keep, "n_symbols", "n_capitals", "n_marks"]
    df = df.select(
        "doc_id", *done,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    done += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    df, eight = join_shifted(df, 8, "hashes", hash_pair, "_h")
    return df.select("doc_id", *done, F.col(eight).alias("w")).select("doc_id", *done, repeated_words(F.col("w"), 8).alias("n_repeat_words"))


def repeated_words(w: Column, k: int) -> Column:
    """Words inside k-word windows that occur twice or more.  w: hashes of the windows in order."""
    ranked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.zip_with(ranked, F.slice(ranked, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + x + k - F.greatest(x, acc["end"])).alias("n"), (x + k).alias("end")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(w)) < F.size(w), covered).otherwise(0).cast("long")


def upper_bound_holds(k: int, n: int, rate: float, risk: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound of k in n, at confidence 1 - risk, is at most rate."""
    if n == 0 or k >= n * rate:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(risk)


def share(rule: str) -> Column:
    a, b = RULES[rule]
    return F.least(F.expr(f"{a} * 1000 div greatest({b}, 1L)"), F.lit(1000)).cast("int")


def least_trials(alpha: float, risk: float) -> int:
    """How many good documents a holdout needs for any promise: with none of them rejected."""
    return math.ceil(math.log(risk) / math.log1p(-alpha))


def proposed(histogram: list[int], steps: tuple[float, ...] = STEPS) -> list[int]:
    """For each step the lowest cutoff above which its share of documents lies.  histogram: by the number of cutoffs exceeded."""
    n = sum(histogram)
    out = []
    for share_ in steps:
        fits = [g for i, g in enumerate(GRID) if sum(histogram[i + 1 :]) <= share_ * n]
        out.append(fits[0] if fits else 1000)
    return out


def accepted(rejected_by_step: list[int], n: int, alpha: float, risk: float) -> int:
    """How many steps hold, tested one after another.  rejected_by_step: documents of the holdout that a step rejects."""
    for i, k in enumerate(rejected_by_step):
        if not upper_bound_holds(k, n, alpha, risk):
            return i
    return len(rejected_by_step)


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict:
    """For each stratum the cutoff of every rule."""
    votes = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    met = stats.join(votes.where("good = 1"), "doc_id", "left_semi")
    good = met.groupBy("doc_id").agg(F.min("lang").alias("lang"), *[F.max(share(r)).alias(r) for r in RULES])
    good = materialize(good.withColumn("holdout", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 1), "good")
    sizes = good.groupBy("lang").agg(F.sum(F.col("holdout").cast("long")).alias("n"))
    # Smaller strata can't be promised anything, so there are at most as many as labels / that number.
    sizes = {r.lang: r.n for r in sizes.where(F.col("n") >= least_trials(alpha, delta)).collect()}
    if not sizes:
        return {}
    level = F.lit(0)
    for g in GRID:
        level = level + (F.col("v") > g).cast("int")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x")
    tested = F.coalesce(F.col("lang").isin([x for x in sizes if x is not None]), F.lit(None in sizes))
    hist: dict[tuple, list[int]] = {}
    for r in good.where(tested & ~F.col("holdout")).select("lang", rows).select("lang", "x.*").groupBy("lang", "rule", level.alias("level")).count().collect():
        hist.setdefault((r.lang, r.rule), [0] * (len(GRID) + 1))[r.level] += r["count"]
    paths = {s: [dict(zip(RULES, x, strict=True)) for x in zip(*(proposed(hist.get((s, r), [0])) for r in RULES), strict=True)] for s in sizes}
    table = small_table(good.sparkSession, [{"s": s, "path": [[step[r] for r in RULES] for step in path]} for s, path in paths.items()], "s string, path array<array<int>>")
    own = good.where(tested & F.col("holdout")).join(F.broadcast(table), F.col("lang").eqNullSafe(F.col("s")))
    fails = [F.sum(_rejects(F.col("path")[i], F.col).cast("long")).alias(str(i)) for i in range(len(STEPS))]
    found = {r.lang: [r[str(i)] for i in range(len(STEPS))] for r in own.groupBy("lang").agg(*fails).collect()}
    chosen = {}
    for s, path in paths.items():
        steps = accepted(found[s], sizes[s], alpha, delta / len(sizes))
        if steps:
            chosen[s] = path[steps - 1]
    return chosen


def _rejects(limits: Column, value) -> Column:
    """Whether any rule's share is above its cutoff."""
    out = F.lit(False)
    for i, rule in enumerate(RULES):
        out = out | (value(rule) > limits[i])
    return out


def verdicts(stats: DataFrame, chosen: dict) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    limits = small_table(stats.sparkSession, [{"s": s, "limits": [x[r] for r in RULES]} for s, x in chosen.items()], "s string, limits array<int>")
    # One row for each stratum that has cutoffs.
    df = stats.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("s")), "left")
    rejects = F.coalesce(_rejects(F.col("limits"), share), F.lit(False))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejects).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed and kept for every row of docs."""
    stats = materialize(text_stats(docs, "lang"), "quality")
    return verdicts(stats, cutoffs(stats, labels, alpha, delta))
