"""Operator 7: page verdicts by url rules and, where none fits, by trust over host links.

Trust is personalised PageRank along links from hosts that the rules allow; distrust is the
same against the links from hosts that they block: who links to a bad host is suspect. All of
it is DataFrame expressions; hosts and links are aggregated before any round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, table

#: (verdict, host, path), fixed by the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rounds end once all scores together change by less than the tolerance and no new host is reached.
DAMPING, TOLERANCE = 0.85, 1e-4
#: A host is blocked if its distrust is over this share of its trust and distrust.
THRESHOLD = 0.5


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path) that fits, as a struct of verdict and name; null if none."""
    fits = F.lit(None).cast("struct<verdict:string,name:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # longer rules wrap shorter ones
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(fit, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("name"))).otherwise(fits)
    return fits


def page_links(html: Column, own: Column) -> Column:
    """Hosts that a page's links name, its own left out; relative links stay on the host."""
    targets = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), 1)
    return F.filter(F.transform(targets, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), lambda t: t != own)


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, score) of personalised PageRank over (src, dst, weight) from (host, weight) seeds.

    Seed weights are scaled to a sum of 1; what hosts without links hold goes back to the
    seeds. Each round is one join on src and one pre-aggregated sum by dst, so a hub's links
    are summed where they lie; every round is checkpointed. Rounds go on until the scores
    change by less than ``tolerance`` together and reach no new host.
    """
    total = F.sum("weight")
    start = cut(seeds.groupBy("host").agg(total.alias("w")).where("w > 0").crossJoin(F.broadcast(seeds.agg(total.alias("all")))).select("host", (F.col("w") / F.col("all")).alias("p")))
    out = edges.groupBy("src").agg(total.alias("out"))
    moves = cut(edges.groupBy("src", "dst").agg(total.alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    score = start.select("host", F.col("p").alias("score"))
    while True:
        moved = score.join(moves, score.host == moves.src).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
        # one row: how much mass has moved on; the rest restarts at the seeds
        rest = moved.agg((1 - F.coalesce(F.sum("score"), F.lit(0.0))).alias("rest"))
        restart = start.crossJoin(F.broadcast(rest)).select("host", (F.col("p") * F.col("rest")).alias("score"))
        new = cut(moved.union(restart).groupBy("host").agg(F.sum("score").alias("score")))
        both = new.select("host", "score", F.lit(1).alias("now")).union(score.select("host", -F.col("score"), F.lit(-1)))
        each = both.groupBy("host").agg(F.abs(F.sum("score")).alias("change"), F.sum("now").alias("now"))
        change, reached = each.agg(F.sum("change"), F.sum(F.abs("now"))).first()
        score = new
        if not reached and (change or 0.0) < tolerance:
            break
    return score


def judge(pages: DataFrame, rules=RULES, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of (page_id, url, html).

    A fitting rule decides. Otherwise the host's distrust decides: blocked if it is over
    ``threshold`` of trust and distrust together, else allowed; a host that no seed reaches is
    allowed. Seeds are hosts with pages that a rule allows or blocks, weighted by those pages.
    Null urls and urls without ``://`` have an empty host, fit no rule and are allowed. A null
    html has no links. Repeated rows are kept, and count in the weights.
    """
    rows = pages.select("page_id", host(F.col("url").cast("string")).alias("host"), path(F.col("url").cast("string")).alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("fit", rule(F.col("host"), F.col("path"), rules))
    links = rows.where("host != ''").select(F.col("host").alias("src"), F.explode(page_links(F.col("html"), F.col("host"))).alias("dst"))
    edges = cut(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    seeds = cut(rows.where("fit is not null and host != ''").groupBy("host", F.col("fit.verdict").alias("verdict")).agg(F.count("*").cast("double").alias("weight")))
    trust = propagate(edges, seeds.where("verdict = 'allow'"), tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, seeds.where("verdict = 'block'"), tolerance)
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).union(distrust.select("host", F.lit(0.0), "score"))
    scores = cut(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    judged = rows.drop("html").join(scores, "host", "left")
    bad = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
