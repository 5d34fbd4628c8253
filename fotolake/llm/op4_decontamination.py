"""Benchmark decontamination, with DataFrame functions only.

Windows of the benchmark's words are hashed; documents are scanned once, and each window of theirs is looked up in
that hash set, which travels in the plan while it has at most ``in_plan`` hashes (checked).  A larger
benchmark goes another way: windows of documents are joined with it by hash, shuffled by Spark.  Either
way hits are then verified word by word, and words inside verified windows count as hit.

Defined cases: null texts have no words and are clean; very long texts are scanned whole, in time linear in their words; items without words match nothing; items with fewer words than a window
are one window; repeated rows are judged each on its own; items with equal windows are all reported;
null item ids are ignored; an empty benchmark leaves everything clean; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import materialize, pick
from fotolake.llm.windows import hash_pair, join_shifted, text_pair

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, IN_PLAN = 10, 60_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), lambda w: w != "")


def hashed(words_: str) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """k (number of words), h (their hash), t (the words, joined) and items of each distinct window."""
    base = pick(benchmark, "item_id", "text").where("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
    base = base.select("item_id", "w", hashed("w").alias("h1"), F.size("w").alias("n"))
    every = None
    for k in range(1, window + 1):
        own = base.where(F.col("n") >= k if k == window else F.col("n") == k)
        own, h = join_shifted(own, k, "h1", hash_pair, "_h")
        own, t = join_shifted(own, k, "w", text_pair, "_t")
        own = own.select("item_id", F.explode(F.arrays_zip(F.col(h).alias("h"), F.col(t).alias("t"))).alias("x"))
        own = own.select(F.lit(k).alias("k"), "x.h", "x.t", "item_id")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("k", "h", "t").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _listed(hashes: list[int]) -> str:
    return ", ".join(f"{h}L" if h != -(2**63) else f"bigint('{h}')" for h in hashes)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, in_plan: int = IN_PLAN) -> DataFrame:
    """Every row of docs (row, doc_id, n_words) with each verified hit (at, k, items), or once with nulls."""
    known = benchmark_windows(benchmark, window)
    # in_plan + 1 hashes at most come to the driver; they decide between the two ways.
    hashes = known.select("k", "h").distinct().limit(in_plan + 1).collect()
    small = len(hashes) <= in_plan
    widths = sorted({r.k for r in (hashes if small else known.select("k").distinct().collect())})
    base = pick(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), "text", words(F.col("text")).alias("w"))
    if not small:
        return _scan_by_join(base, known, widths)
    base = base.select("doc_id", "row", "w", F.size("w").alias("n_words"), hashed("w").alias("h1"))
    hits = [F.array().cast("array<struct<k:int,at:int,t:string>>")]
    of = {k: _listed([r.h for r in hashes if r.k == k]) for k in widths}
    some = F.lit(False)
    names = {}
    for k in widths:
        base, names[k] = join_shifted(base, k, "h1", hash_pair, "_h")
        some = some | F.expr(f"exists({names[k]}, x -> x in ({of[k]}))")
    # Words are put together only in texts where a hash was met.
    base = base.withColumn("_w", F.when(some, F.col("w")).otherwise(F.array().cast("array<string>")))
    for k in widths:
        base, t = join_shifted(base, k, "_w", text_pair, "_t")
        met = F.expr(f"zip_with(slice({names[k]}, 1, size({t})), {t}, (x, y) -> if(x in ({of[k]}), y, null))")
        hits.append(F.array_compact(F.transform(met, _with_text(k))))
    rows = base.select("row", "doc_id", "n_words", F.explode_outer(F.concat(*hits)).alias("x")).select("row", "doc_id", "n_words", "x.*")
    # At most in_plan windows and their items.
    return _met(rows.join(F.broadcast(known.select("k", "t", "items")), ["k", "t"], "left"))


def _scan_by_join(base: DataFrame, known: DataFrame, widths: list[int]) -> DataFrame:
    """The same hits for a benchmark of any size: windows meet it by hash, and those that do are compared by their words.

    Texts are known by a digest; of equal texts one is compared.  Only texts with a window that met are shuffled.
    """
    keyed = base.select("row", "doc_id", "w", F.size("w").alias("n_words"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    hashes = keyed.select("key", "w", hashed("w").alias("h1"))
    every = []
    for k in widths:
        hashes, h = join_shifted(hashes, k, "h1", hash_pair, "_h")
        every.append(F.transform(h, _with_hash(k)))
    places = F.array().cast("array<struct<k:int,at:int,h:bigint>>")
    met = hashes.select("key", F.explode(F.concat(places, *every)).alias("x")).select("key", "x.*")
    met = materialize(met.join(known.select("k", "h").distinct(), ["k", "h"]).dropDuplicates(["key", "k", "at"]), "met")
    texts = keyed.select("key", "w").join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    of_text = met.groupBy("key").agg(F.collect_list(F.struct("k", "at")).alias("places"))  # at most a few for each word of the text
    said = F.transform("places", lambda x: F.struct(x["k"].alias("k"), x["at"].alias("at"), F.array_join(F.slice("w", x["at"] + 1, x["k"]), " ").alias("t")))
    told = texts.join(of_text, "key").select("key", F.explode(said).alias("x")).select("key", "x.*")
    told = told.join(known.select("k", "t", "items"), ["k", "t"]).select("key", "at", "k", "items")
    return _met(keyed.select("row", "doc_id", "n_words", "key").join(told, "key", "left"))


def _with_text(k: int):
    return lambda y, at: F.when(y.isNotNull(), F.struct(F.lit(k).alias("k"), at.alias("at"), y.alias("t")))


def _with_hash(k: int):
    return lambda h, at: F.struct(F.lit(k).alias("k"), at.alias("at"), h.alias("h"))


def _met(rows: DataFrame) -> DataFrame:
    there = F.col("items").isNotNull()
    return rows.select("row", "doc_id", "n_words", F.when(there, F.col("at")).alias("at"), F.when(there, F.col("k")).alias("k"), "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, in_plan: int = IN_PLAN) -> DataFrame:
    """row, doc_id, n_words, n_hit, hits (start and end in words, in order) and items of each row of docs."""
    hit = F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("k")).alias("end")))
    one = (
        scan(docs, benchmark, window, in_plan)
        .groupBy("row", "doc_id", "n_words")
        .agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )
    n_hit = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"], acc["end"]) - F.greatest(x["at"], acc["end"])).alias("n"),
            F.greatest(x["end"], acc["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    return one.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), "hits", "items")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, in_plan: int = IN_PLAN) -> DataFrame:
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return report(docs, benchmark, window, in_plan).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(named, "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, in_plan: int = IN_PLAN) -> DataFrame:
    """docs without its contaminated documents, or (mode "spans") without the words that were hit.

    Rows are told apart by a hash of their text, for equal texts have equal hits: rows with a null or a repeated
    id are judged each on its own.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.sha2(text, 256).alias("doc_id"), F.col("text"))
    bad = report(keyed, benchmark, window, in_plan).where("n_hit > 0").select(F.col("doc_id").alias("_bad"), "hits")
    if mode == "documents":
        return docs.join(bad.select("_bad").distinct(), F.sha2(text, 256) == F.col("_bad"), "left_anti")
    cut = bad.groupBy(F.col("_bad").alias("_key")).agg(F.first("hits").alias("_hits"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = docs.withColumn("_key", F.sha2(text, 256)).join(cut, "_key", "left").withColumn("_w", F.regexp_extract_all(text, F.lit(word), F.lit(0))).withColumn("_g", F.split(text, word))
    places = F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.sequence(x["at"], x["end"] - 1))))
    split = split.withColumn("_stay", F.array_except(F.sequence(F.lit(0), F.size("_w") - 1), places))
    parts = F.transform("_stay", lambda i: F.concat(F.get("_g", i), F.get("_w", i)))
    clean = F.concat(F.array_join(parts, ""), F.element_at("_g", -1))
    kept = F.when(F.col("_hits").isNull(), F.col("text")).otherwise(clean)
    return split.withColumn("text", kept).select(*docs.columns)
