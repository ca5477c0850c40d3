"""Identities that people join and keep apart: review decisions, alias lists, re-pointing, orphans.

A decision says of two identities that they are one (accept) or not (reject); of several about one pair the latest counts, whichever way round it is
written. Classes are the connected components of the accepted pairs, and a class is known by its smallest member. A rejected pair is no wall: two identities that others connect share a class, which
``conflicts`` then lists. So classes depend on the set of decisions and not on the order in which they came.

``updated`` brings classes up to date after new decisions at the cost of the classes that these touch, and gives what a rebuild would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arenaflow.functions import names as N
from arenaflow.operators.graph import components
from arenaflow.shared import written

DECISIONS = "number long, a string, b string, accept boolean"
ALIASES = "canonical_id string, display string, login string, variants array<string>"


def in_force(decisions: DataFrame) -> DataFrame:
    """a < b, accept: the latest decision on each pair. Rows with a null or with a equal to b are left out."""
    pairs = decisions.filter("a is not null and b is not null and a <> b and accept is not null")
    pairs = pairs.select("number", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "accept")
    return pairs.groupBy("a", "b").agg(F.max_by("accept", F.struct("number", "accept")).alias("accept"))


def classes(decisions: DataFrame) -> DataFrame:
    """id, root of every identity in an accepted pair; others are classes of their own."""
    return components(in_force(decisions).filter("accept").select("a", "b"))


def updated(state: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (id, root) after ``new`` decisions were added to ``old``, of which ``state`` holds the classes, and what changed: id, was
    and root of the identities whose class has another name now. Only classes that hold an end of a new decision are computed anew."""
    ends = new.select(F.explode(F.array("a", "b")).alias("id")).filter("id is not null").distinct()
    touched = state.join(state.join(ends, "id").select("root").distinct(), "root", "left_semi").select("id", "root")
    members = written(touched.select("id").union(ends).distinct(), "members")
    # all accepted pairs of a member lie inside its class or are new
    near = old.unionByName(new)
    near = near.join(members.select(F.col("id").alias("a")), "a", "left_semi").unionByName(near.join(members.select(F.col("id").alias("b")), "b", "left_semi")).distinct()
    again = components(in_force(near).filter("accept").select("a", "b"))
    after = state.select("id", "root").join(members, "id", "left_anti").unionByName(again)
    before = members.join(state, "id", "left").select("id", F.coalesce("root", "id").alias("was"))
    changed = before.join(again, "id", "left").select("id", "was", F.coalesce("root", "id").alias("root")).filter("was <> root")
    return written(after, "classes"), written(changed, "changed")


def conflicts(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """a, b, root: rejected pairs that accepted ones connect all the same."""
    rejected = in_force(decisions).filter("not accept").select("a", "b")
    ra, rb = state.select(F.col("id").alias("a"), "root"), state.select(F.col("id").alias("b"), F.col("root").alias("other"))
    return rejected.join(ra, "a").join(rb, "b").filter("root = other").select("a", "b", "root")


def moved(facts: DataFrame, changed: DataFrame, column: str) -> DataFrame:
    """The facts of changed identities under their new name: all that has to be written again."""
    return facts.join(changed.select(F.col("id").alias(column), F.col("root").alias("__root")), column).withColumn(column, F.col("__root")).select(*facts.columns)


def repointed(facts: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """All facts under the names of their classes."""
    roots = state.select(F.col("id").alias(column), F.col("root").alias("__root"))
    return facts.join(roots, column, "left").withColumn(column, F.coalesce("__root", column)).select(*facts.columns)


def orphans(identities: DataFrame, facts: DataFrame, id_col: str = "canonical_id") -> DataFrame:
    """Identities (of rows not hidden yet, where there is a column hidden) that no fact points to: those to hide."""
    shown = identities.filter(~F.coalesce("hidden", F.lit(False))) if "hidden" in identities.columns else identities
    return shown.join(facts.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), id_col, "left_anti")


def review_queue(identities: DataFrame, facts: DataFrame, variants: DataFrame, at: str, least: int = 20, most: int = 100, isolated: bool = True) -> DataFrame:
    """canonical_id, matches, variants, last_seen of identities neither hidden nor reviewed with so many matches; ``isolated`` keeps those with at most one
    spelling. ``facts`` has canonical_id, match_id and the time ``at``; matches are counted once however many rows they have."""
    played = facts.groupBy("canonical_id").agg(F.countDistinct("match_id").alias("matches"), F.max(at).alias("last_seen")).filter(F.col("matches").between(least, most))
    spelt = variants.groupBy("canonical_id").agg(F.countDistinct("raw_name").alias("variants"))
    open_ = identities.filter(~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("reviewed", F.lit(False)))
    rows = open_.join(played, "canonical_id").join(spelt, "canonical_id", "left").withColumn("variants", F.coalesce("variants", F.lit(0)))
    return (rows.filter("variants <= 1") if isolated else rows).select("canonical_id", "matches", "variants", "last_seen")


def alias_keys(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """login -> canonical_id and normal form -> canonical_id of an alias list; an entry's own id is one of its spellings. What two entries
    claim goes to the smaller id."""
    logins = aliases.filter("login <> ''").groupBy("login").agg(F.min("canonical_id").alias("by_login"))
    spelt = aliases.select("canonical_id", F.explode(F.concat(F.array("canonical_id"), F.coalesce("variants", F.array().cast("array<string>")))).alias("variant"))
    forms = spelt.select("canonical_id", F.lower("variant").alias("form")).filter("form <> ''")
    return logins, forms.groupBy("form").agg(F.min("canonical_id").alias("by_form"))


def applied(aliases: DataFrame, players: DataFrame) -> DataFrame:
    """player_name, canonical_id of the names that an alias list claims: by login first, else by normal form. A name with several logins goes
    to the smallest id among them."""
    logins, forms = alias_keys(aliases)
    names = players.select("player_name", F.nullif("player_login", F.lit("")).alias("login")).filter("player_name is not null").distinct()
    found = names.join(logins, "login", "left").withColumn("form", N.normalised("player_name")).join(forms, "form", "left")
    target = found.groupBy("player_name").agg(F.coalesce(F.min("by_login"), F.min("by_form")).alias("canonical_id"))
    return target.filter("canonical_id is not null")


def upserted_displays(identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Identities (canonical_id, display_name, login) with the alias list's names; an empty login keeps the old one."""
    listed = aliases.select("canonical_id", F.coalesce("display", "canonical_id").alias("__display"), F.nullif("login", F.lit("")).alias("__login")).dropDuplicates(["canonical_id"])
    both = identities.join(listed, "canonical_id", "full_outer")
    return both.select("canonical_id", F.coalesce("__display", "display_name").alias("display_name"), F.coalesce("__login", "login").alias("login"))


def first_of_name(rows: DataFrame) -> DataFrame:
    """One row for each name: the busiest login's, then the smallest login."""
    n = rows.groupBy("player_name", "player_login").agg(F.count("*").alias("n"))
    w = W.partitionBy("player_name").orderBy(F.desc("n"), F.asc_nulls_last("player_login"))
    return n.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
