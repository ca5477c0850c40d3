"""URL filter: rules by host and path, and link-graph propagation for the hosts that no rule settles. DataFrame functions only.

Hosts of the pages and of their absolute links are the nodes, links between different hosts the edges. Trust starts at hosts with an
allow rule's page and flows along the links; distrust starts at hosts most of whose pages a rule blocks and flows against them
(who links to bad hosts is distrusted). Both are personalised PageRanks with a fixed number of rounds; a round is one join and one sum
over distinct host edges. A host is blocked if its distrust exceeds its trust and ``least`` times the mean score of a host.

Cases: a null url or one without ``://`` has an empty host and path, no rule and the verdict allow; null html has no links; repeated
rows each give a row; of rules that fit, the longest wins; the weight of hosts without links returns to the seeds.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import written

#: Verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
LINK = r"""(?i)(?:href|src)\s*=\s*["']([a-z][a-z0-9+.-]*://[^"'\s>]+)"""
DAMPING, ROUNDS, LEAST = 0.85, 10, 2.0


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules, what) -> Column:
    """``what(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]), what(r)).otherwise(out)
    return out


def judged_by_rule(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict (null without a rule)."""
    host, path = F.col("host"), F.col("path")
    return (
        pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
        .withColumns({"rule": fitting(host, path, rules, lambda r: r[1] + r[2]), "by_rule": fitting(host, path, rules, lambda r: r[0])})
    )


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts; sums are made before the shuffle."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("link"))
    ends = links.select("src", host_of(F.col("link")).alias("dst")).filter("src <> dst and src <> '' and dst <> ''")
    return ends.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(judged: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust of every host that has either; ``judged`` has host and by_rule."""
    seeds = (
        judged.filter("host <> ''").groupBy("host")
        .agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("bad"), F.count_if(F.col("by_rule") == "allow").alias("good"))
        .withColumn("kind", F.when(F.col("bad") * 2 > F.col("n"), "distrust").when(F.col("good") > 0, "trust"))
        .filter("kind is not null").select("kind", "host")
    )
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("of"))
    seeds = written(seeds.join(F.broadcast(sizes), "kind").select("kind", "host", (F.lit(1.0) / F.col("of")).alias("score")), "seeds")  # two rows
    forth = edges.join(edges.groupBy("src").agg(F.sum("n").alias("of")), "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("of")).alias("share"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("n").alias("of")), "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("of")).alias("share"))
    flow = written(forth.unionByName(back), "flow")
    state = seeds
    for _ in range(rounds):
        moved = flow.join(state, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        moved = written(moved.groupBy("kind", "host").agg(F.sum("score").alias("score")), "moved")
        went = F.broadcast(moved.groupBy("kind").agg(F.sum("score").alias("went")))  # two rows
        # what the walk doesn't carry on, from damping and from hosts without links, starts anew at the seeds
        restart = seeds.join(went, "kind", "left").select("kind", "host", (F.col("score") * (1 - F.coalesce("went", F.lit(0.0)))).alias("score"))
        state = restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")]
    return state.groupBy("host").agg(*sums)


def judge(pages: DataFrame, rules=RULES, least: float = LEAST, rounds: int = ROUNDS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, settled_by (rule or graph) of every row."""
    judged = judged_by_rule(pages.select(id_col, url_col), rules, url_col)
    edges = written(host_edges(pages, url_col, html_col), "edges")
    scores = host_scores(judged.select("host", "by_rule"), edges, rounds=rounds)
    hosts = judged.select("host").union(edges.select("src")).union(edges.select("dst")).filter("host <> ''").distinct().count()
    bad = scores.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") * hosts > least)).select("host", F.lit("block").alias("by_graph"))
    return judged.join(bad, "host", "left").select(
        id_col, "host", "path", "rule",
        F.coalesce("by_rule", "by_graph", F.lit("allow")).alias("verdict"),
        F.when(F.col("by_rule").isNotNull(), "rule").otherwise("graph").alias("settled_by"),
    )
