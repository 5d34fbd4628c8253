"""URL filter: rules first, then link-graph propagation for what no rule fits.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and follows
links backwards, to those who link there.  Both are personalised PageRanks over host edges, in pages: a seed
restarts with the number of its pages that a rule allows or blocks.  A host is blocked if its distrust
exceeds its trust and its pages that no rule fits taken together, i.e. if bad company outweighs
all else that is known of it.

Defined cases: a null url, or one without "://", has an empty host and path and is allowed (no host to judge);
null html has no links; links without a host stay within their host and say nothing; of rules equally
long, the one with the longer host wins, then the first by name; repeated rows are kept; no pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import materialize, pick

#: Rules: verdict, host, start of the path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, ROUNDS, IN_PLAN = 0.85, 12, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (with host and path) and the longest fitting rule and its verdict, or nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    if len(ranked) <= IN_PLAN:
        name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for v, host, start in reversed(ranked):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(start)
            name, verdict = F.when(fits, F.lit(host + start)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
        return pages.select("*", name.alias("rule"), verdict.alias("ruled"))
    # A long list: every suffix of a page's host meets the rules of that host.
    listed = pages.sparkSession.createDataFrame([(h, s, v, i, h + s) for i, (v, h, s) in enumerate(ranked)], "rule_host string, start string, v string, i int, name string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda k: F.array_join(F.slice("_l", k, F.size("_l")), "."))
    rows = pages.withColumn("_row", F.monotonically_increasing_id()).withColumn("_l", labels)
    met = rows.select("_row", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").where(F.col("path").startswith(F.col("start")))
    best = met.groupBy("_row").agg(F.min_by(F.struct("name", "v"), "i").alias("best"))
    return rows.join(best, "_row", "left").select(*pages.columns, F.col("best.name").alias("rule"), F.col("best.v").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts.  pages: host, html."""
    links = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    edges = pages.where("host <> ''").select(F.col("host").alias("src"), links.alias("link")).select("src", host_of(target).alias("dst"))
    return edges.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """kind, host, mass.  edges: src, dst, n.  seeds: kind ("trust" follows links, "distrust" goes backwards), host, mass.

    Mass that reaches a host without further links ends there.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    steps = materialize(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("n") / F.col("total")).alias("share")), "steps")
    seeds = materialize(seeds, "seeds")
    now = start = seeds.select("kind", "host", ((1 - damping) * F.col("mass")).alias("mass"))
    if not steps.limit(1).count():
        return start
    for k in range(rounds):
        moved = steps.join(now, (steps["kind"] == now["kind"]) & (steps["src"] == now["host"])).select(steps["kind"], F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
        now = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % 4 == 3:
            now = materialize(now, "ranks")
    return now


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    base = pick(pages, "page_id", "url", "html")
    named = with_rules(base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    edges = host_edges(base.select(host_of(F.col("url")).alias("host"), "html"))
    hosts = named.where("host <> ''").groupBy("host").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("trust", F.col("ruled") == "allow"), ("distrust", F.col("ruled") == "block"), ("open", F.col("ruled").isNull()))])
    hosts = materialize(hosts, "hosts")
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("trust").alias("mass")).unionByName(hosts.select(F.lit("distrust").alias("kind"), "host", F.col("distrust").alias("mass"))).where("mass > 0")
    ranks = propagate(edges, seeds).groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(f"{k}_rank") for k in ("trust", "distrust")])
    bad = hosts.join(ranks, "host").where(F.col("distrust_rank") > F.col("trust_rank") + (1 - DAMPING) * F.col("open")).select(F.col("host").alias("bad_host"))
    out = named.join(bad, F.col("host") == F.col("bad_host"), "left")
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))

