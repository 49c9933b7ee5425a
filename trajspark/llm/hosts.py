"""URL filters: rules, and for what no rule fits trust and distrust spread over links between hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import cut

#: (verdict, host, beginning of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
HREF = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (host and path together), or null: a chain of conditions from long to short."""
    out = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def host_scores(pages: DataFrame, links: DataFrame, damping: float = 0.85, every: int = 5, tolerance: float = 1e-3) -> DataFrame:
    """(host, trust, distrust): personalised PageRank over links from trusted seeds, and over reversed links from blocked ones.

    ``pages`` has host and seed ('allow', 'block' or null) per page; a host is a seed by the share of its pages that a rule allows or
    blocks. ``links`` has src, dst and weight; a host passes trust on over its links by their weights, and distrust back to those that link
    to it. Both walks restart at their seeds, and what reaches a host without links restarts there too. Messages are summed before and after
    the shuffle; the result is stored every few rounds. A round shrinks what is still to come by ``damping``; the walk ends when the moves of all
    hosts together are below ``tolerance`` of a host's fair share (one over the number of hosts). The tables have one row per host or pair of
    hosts.
    """
    seeds = pages.groupBy("host").agg((F.sum(F.when(F.col("seed") == "allow", 1).otherwise(0)) / F.count("*")).alias("a"), (F.sum(F.when(F.col("seed") == "block", 1).otherwise(0)) / F.count("*")).alias("b"))
    known = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    seeds = known.join(seeds, "host", "left").select("host", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    walks = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("a").alias("seed")), F.struct(F.lit("distrust").alias("kind"), "host", F.col("b").alias("seed")))).alias("x")).select("x.*")
    walks = cut(walks)
    totals = {r.kind: r.s for r in walks.groupBy("kind").agg(F.sum("seed").alias("s")).collect()}
    share = F.when(F.col("kind") == "trust", F.lit(float(totals.get("trust") or 1.0))).otherwise(F.lit(float(totals.get("distrust") or 1.0)))
    walks = walks.withColumn("seed", F.col("seed") / share)
    both = links.where("src <> dst").select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(links.where("src <> dst").select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("weight")))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    steps = cut(both.groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight")).join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    state = cut(walks.withColumn("rank", F.col("seed")))
    has = steps.select("kind", F.col("src").alias("host"), F.lit(1.0).alias("linked")).distinct()
    state = cut(state.join(has, ["kind", "host"], "left").select("kind", "host", "seed", "rank", F.coalesce("linked", F.lit(0.0)).alias("linked")))
    least = tolerance * (1 - damping) / max(seeds.count(), 1)
    turn, moved = 0, 0.0 if steps.isEmpty() else 1.0
    while moved >= least:
        turn += 1
        sent = state.select("kind", F.col("host").alias("src"), "rank").join(steps, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        kept = state.groupBy("kind").agg(F.sum(F.col("rank") * (1 - F.col("linked"))).alias("loose"))
        new = state.join(sent, ["kind", "host"], "left").join(F.broadcast(kept), "kind")  # two rows, one per walk
        rank = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("seed"))
        state = new.select("kind", "host", "seed", rank.alias("rank"), "linked", F.col("rank").alias("before"))
        if turn % every == 0:
            state = cut(state)
            moved = state.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
        state = state.drop("before")
    return state.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links of pages to other hosts, a page counting once per pair; combined before the shuffle."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(HREF), F.lit(1)),
                                           lambda u: F.translate(F.regexp_extract(u, r"^(?i:https?:)?//([^/?#]*)", 1), _UPPER, _LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def url_verdicts(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust and distrust.

    The longest rule that fits a url decides. Other urls are judged by their host: trust spreads from hosts whose pages rules allow along
    links, distrust from hosts whose pages rules block against the links. A host is blocked if distrust makes up more than ``threshold`` of
    both and is more than its fair share (one over the number of hosts); hosts that neither reaches are allowed.

    Urls that are null or have no ``://`` have an empty host and path, fit no rule and are allowed. A null html has no links. Rows may
    repeat; extra columns are ignored; an empty table gives an empty result.
    """
    host, path = host_path(F.col("url").cast("string"))
    base = pages.select("page_id", F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdicts = {h + p: v for v, h, p in rules}
    told = reduce(lambda out, kv: F.when(F.col("rule") == kv[0], F.lit(kv[1])).otherwise(out), verdicts.items(), F.lit(None).cast("string"))
    judged = base.withColumn("told", told)
    seeds = judged.where("host <> ''").select("host", F.col("told").alias("seed"))
    scores = cut(host_scores(seeds, cut(host_links(base))))
    hosts = max(scores.count(), 1)
    blocked = (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") > 1.0 / hosts)
    scores = scores.withColumnRenamed("host", "_host").withColumn("blocked", blocked)
    out = judged.join(scores, judged["host"] == scores["_host"], "left")
    verdict = F.coalesce("told", F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")).alias("verdict")
    return out.select("page_id", "host", "path", "rule", verdict, F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
