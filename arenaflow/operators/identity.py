"""Entity resolution and duplicate matches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import names as N

#: Least similarity of an automatic match and of one for review, shortest name that is compared.
SAME, REVIEW, SHORTEST = 0.92, 0.78, 4


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def letters(name: str):
    """The letters of a column, each with its occurrence number, in one order for all names: repeated and rare ones first."""
    common = "etaoinshrdlcumwfgypbvkjxqz"
    rare = f"if(instr('{common}', c) = 0, 99, instr('{common}', c))"
    nth = f"length(substring({name}, 1, i)) - length(replace(substring({name}, 1, i), c, ''))"
    one = f"transform(array(substring({name}, i, 1)), c -> struct(-({nth}) as nth, -{rare} as rare, c as c))[0]"
    return F.expr(f"array_sort(transform(sequence(1, length({name})), i -> {one}))")


def first_letters(of, length):
    """Of the ordered letters so many that two names of ratio REVIEW or more have one in common. The ratio needs m >= REVIEW / 2 * (n + k)
    common letters and the other name has k >= m, so m >= REVIEW / (2 - REVIEW) * n; sets with m common members share one
    among the first n - m + 1 of each."""
    return F.slice(of, F.lit(1), (length - F.ceil(length * (REVIEW / (2 - REVIEW)) - 1e-9) + 1).cast("int"))


def resolve(raw: DataFrame, variants: DataFrame, excludes: DataFrame | None = None) -> DataFrame:
    """raw_name, login -> canonical_id, how (login, exact, fuzzy, review, new) and score.

    ``variants``: canonical_id, variant (any spelling or login). One deterministic pass: no name sees what another was resolved to.
    Fuzzy pairs meet by an equi key without loss (see ``first_letters``) and lie in a length band. A name in
    ``excludes`` (canonical_id, variant) never matches that identity fuzzily. Null names stay unresolved.
    """
    known = variants.select("canonical_id", N.normalised("variant").alias("norm")).filter("norm <> ''").distinct()
    named = raw.select("raw_name", "login", N.normalised("raw_name").alias("norm"))
    by_login = named.filter("login is not null").join(known.select("canonical_id", F.col("norm").alias("login_norm")), N.normalised("login") == F.col("login_norm"))
    by_name = named.join(known, "norm")
    hit = lambda df, k, how: df.select("raw_name", F.struct(F.lit(k).alias("k"), F.lit(0.0).alias("loss"), "canonical_id", F.lit(how).alias("how")).alias("m"))
    exact = hit(by_login, 0, "login").union(hit(by_name, 1, "exact"))
    rest = named.filter(F.length("norm") >= SHORTEST).join(exact.select("raw_name"), "raw_name", "left_anti").select("raw_name", F.col("norm").alias("x")).distinct()
    left = rest.select("raw_name", "x", letters("x").alias("xs")).withColumn("block", F.explode(first_letters(F.col("xs"), F.length("x"))))
    right = known.filter(F.length("norm") >= SHORTEST).select("canonical_id", F.col("norm").alias("y"), letters("norm").alias("ys")).withColumn("block", F.explode(first_letters(F.col("ys"), F.length("y"))))
    pairs = left.join(right, "block").filter(F.greatest(F.length("x"), F.length("y")) <= (2 / REVIEW - 1) * F.least(F.length("x"), F.length("y")))
    pairs = pairs.filter(F.size(F.array_intersect("xs", "ys")) >= REVIEW / 2 * (F.length("x") + F.length("y")) - 1e-9)
    pairs = pairs.select("raw_name", "x", "y", "canonical_id").distinct()
    if excludes is not None:
        out = excludes.select("canonical_id", N.normalised("variant").alias("x"))
        pairs = pairs.join(out, ["canonical_id", "x"], "left_anti")
    scored = pairs.withColumn("score", F.pandas_udf(ratio, "double")("x", "y")).filter(F.col("score") >= REVIEW)
    fuzzy = scored.select("raw_name", F.struct(F.lit(2).alias("k"), (1 - F.col("score")).alias("loss"), "canonical_id", F.when(F.col("score") >= SAME, "fuzzy").otherwise("review").alias("how")).alias("m"))
    best = exact.union(fuzzy).groupBy("raw_name").agg(F.min("m").alias("m"))
    return raw.select("raw_name").distinct().join(best, "raw_name", "left").select(
        "raw_name", "m.canonical_id", F.when(F.col("raw_name").isNotNull(), F.coalesce("m.how", F.lit("new"))).alias("how"), (1 - F.col("m.loss")).alias("score"))


def minted(names: DataFrame) -> DataFrame:
    """raw_name -> a new slug, with a number where slugs collide."""
    slug = F.regexp_replace(F.regexp_replace(N.normalised("raw_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = names.select("raw_name", F.when(slug == "", "player").otherwise(slug).alias("slug")).distinct()
    n = F.row_number().over(W.partitionBy("slug").orderBy("raw_name"))
    return s.withColumn("n", n).select("raw_name", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")).alias("canonical_id"))


def display_names(seen: DataFrame) -> DataFrame:
    """canonical_id -> the most frequent clean spelling (only printable plain characters), else the most frequent."""
    n = seen.groupBy("canonical_id", "raw_name").agg(F.count("*").alias("n"))
    clean = F.col("raw_name").rlike(r"^[\x20-\x7e]+$").cast("int")
    return n.groupBy("canonical_id").agg(F.max_by("raw_name", F.struct(clean, "n", F.col("raw_name"))).alias("display_name"))


def near_duplicate_matches(matches: DataFrame, players: DataFrame, minutes: int = 30) -> DataFrame:
    """kept, dropped: matches of both sources (positive and negative ids) with the same arena and players within some minutes; the
    negative one goes. Greedy in time within a signature, each match in one pair at most."""
    sig = players.groupBy("match_id").agg(F.array_join(F.array_sort(F.collect_set("canonical_id")), "|").alias("sig"))
    m = matches.select("match_id", "match_map", F.unix_seconds(F.col("match_date").cast("timestamp")).alias("t")).join(sig, "match_id").filter("t is not null")
    both = m.groupBy("match_map", "sig").agg(F.min("match_id").alias("lo"), F.max("match_id").alias("hi")).filter("lo < 0 and hi > 0").select("match_map", "sig")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "match_id"])
        out, used = [], set()
        live = rows[rows.match_id > 0]
        for r in rows[rows.match_id < 0].itertuples():
            near = live[(live.t - r.t).abs() <= minutes * 60]
            for k in near.assign(d=(near.t - r.t).abs()).sort_values(["d", "match_id"]).match_id:
                if k not in used:
                    used.add(k)
                    out.append((k, r.match_id))
                    break
        return pd.DataFrame(out, columns=["kept", "dropped"])

    # runs with gaps of more than the minutes are independent, so a busy signature is many small groups
    w = W.partitionBy("match_map", "sig").orderBy("t", "match_id")
    runs = m.join(both, ["match_map", "sig"], "left_semi").withColumn("b", (F.col("t") - F.lag("t").over(w) > minutes * 60).cast("int")).withColumn("run", F.sum(F.coalesce("b", F.lit(0))).over(w))
    return runs.groupBy("match_map", "sig", "run").applyInPandas(greedy, "kept long, dropped long")


def alnum(name: str):
    """Letters and digits of a name in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def resolve_key(wanted: DataFrame, known: DataFrame, least: int = SHORTEST) -> DataFrame:
    """group, name, key and kind (0 exact, 1 but for case, 2 but for other signs, 3 one's letters begin the other's) of every wanted name (group, name): the best
    kind, then the smallest key, of the group's known keys (group, key). Names of one group only meet its keys. For the last kind both
    have ``least`` letters at least, and each meets the other by its whole form among the other's beginnings: equi joins throughout."""
    w = wanted.distinct().withColumn("form", alnum("name"))
    k = known.select("group", "key").distinct().withColumn("form", alnum("key"))
    starts = lambda c: F.when(F.length(c) >= least, F.transform(F.sequence(F.lit(least), F.length(c)), lambda i: F.substring(c, F.lit(1), i)))
    hit = lambda df, kind: df.select("group", "name", F.struct(F.lit(kind).alias("kind"), "key").alias("m"))
    exact = hit(w.join(k.select("group", "key", F.col("key").alias("name")), ["group", "name"]), 0)
    cased = hit(w.withColumn("low", F.lower("name")).join(k.select("group", "key", F.lower("key").alias("low")), ["group", "low"]), 1)
    formed = hit(w.filter("form <> ''").join(k.select("group", "key", "form"), ["group", "form"]), 2)
    long_names = w.select("group", "name", F.explode(starts(F.col("form"))).alias("form")).join(k.select("group", "key", "form"), ["group", "form"])
    long_keys = w.filter(F.length("form") >= least).join(k.select("group", "key", F.explode(starts(F.col("form"))).alias("form")), ["group", "form"])
    best = exact.union(cased).union(formed).union(hit(long_names, 3)).union(hit(long_keys, 3)).groupBy("group", "name").agg(F.min("m").alias("m"))
    return wanted.join(best, ["group", "name"], "left").select("group", "name", "m.key", "m.kind")
