"""File sources with explicit schemas."""

from __future__ import annotations

import io
import json
import tarfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.functions import names as N

#: Weapons of a match record.
WEAPONS = ("sg", "ssg", "gl", "rl", "lg")


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def match_schema() -> T.StructType:
    """Nested per-match statistics, as they are published; every branch may be missing."""
    i, s = T.LongType(), T.StringType()
    weapon = struct(acc=struct(attacks=i, hits=i, virtual=i), damage=struct(enemy=i, team=i))
    item = struct(took=i, time=i)
    player = struct(
        name=s, login=s, team=s, ping=i, stats=struct(frags=i, deaths=i, tk=i), dmg=struct(taken=i, given=i),
        weapons=struct(**{w: weapon for w in WEAPONS}), items=struct(ra=item, ya=item, ga=item, q=item), xferRL=i)
    return struct(match_id=i, date=s, map=s, mode=s, hostname=s, demo=s, players=T.ArrayType(player))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; what doesn't parse has a null match_id and its text in ``_corrupt_record``."""
    schema = match_schema().add("_corrupt_record", T.StringType())
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def matches_and_players(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat tables of nested records: absent counts are 0, of a name that repeats in a match the first counts."""
    at = F.coalesce(F.expr("try_to_timestamp(date, 'yyyy-MM-dd HH:mm:ss Z')"), F.expr("try_to_timestamp(date)"))
    good = records.filter("match_id is not null")
    matches = good.select("match_id", at.alias("match_date"), F.col("mode").alias("match_mode"), F.col("map").alias("match_map"), N.host_root("hostname").alias("server_hostname"), N.basename("demo").alias("demo_name"))
    p = good.select("match_id", F.posexplode("players").alias("n", "p"))
    firsts = p.groupBy("match_id", F.col("p.name").alias("player_name")).agg(F.min_by("p", "n").alias("p"))
    dig = lambda path: F.coalesce(F.col(f"p.{path}"), F.lit(0))
    cols = [F.col("p.login").alias("player_login"), F.col("p.team").alias("player_team"), F.col("p.ping").alias("player_ping")]
    cols += [dig(f"stats.{k}").alias(f"player_{k}") for k in ("frags", "deaths", "tk")] + [dig(f"dmg.{k}").alias(f"player_damage_{k}") for k in ("given", "taken")]
    cols += [dig(f"weapons.{w}.acc.{k}").alias(f"player_{w}_{k}") for w in WEAPONS for k in ("attacks", "hits")]
    cols += [dig(f"items.{k}.took").alias(f"player_{k}_taken") for k in ("ra", "ya", "ga", "q")]
    return matches, firsts.select("match_id", "player_name", *cols)


def readable(content: bytes, suffix: str = ".json"):
    """Names and texts of an archive's JSON members; a broken archive ends at the place where it breaks, a broken member is left out."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(suffix):
                    text = tar.extractfile(m).read().decode("utf-8", "replace")
                    try:
                        json.loads(text)
                    except ValueError:
                        continue
                    yield m.name, text
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        return


def archive_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """archive, member, text of every readable JSON member of ``.tar.gz`` files; an archive is read member by member in its task."""

    def members(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                for member, text in readable(content, suffix):
                    yield pd.DataFrame({"archive": [name], "member": [member], "text": [text]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(members, "archive string, member string, text string")


def parsed_servers(snapshots: DataFrame) -> DataFrame:
    """hostname, players (array of names) of live snapshots; text that isn't JSON gives an empty array."""
    players = F.from_json("current_players_json", "array<struct<name:string>>")
    return snapshots.select("hostname", N.host_root("hostname").alias("host_root"), F.coalesce(F.transform(players, lambda p: p["name"]), F.array().cast("array<string>")).alias("players"))


def keyed_documents(keys: DataFrame, root: str, schema: T.StructType) -> DataFrame:
    """key, document and state (found, broken or missing) of every key of ``keys`` (key): documents lie in ``root/ab/abcd....json``, by the first two signs
    of their key. Only files are listed; those of other keys aren't parsed."""
    spark = keys.sparkSession
    files = spark.read.text(f"{root}/*/*.json", wholetext=True).select(F.regexp_replace(N.basename(F.col("_metadata.file_path")), r"\.json$", "").alias("key"), "value")
    asked = keys.select("key").distinct()
    found = asked.join(files, "key", "left").withColumn("document", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    fine = F.col("value").isNotNull() & F.to_json("document").isNotNull() & (F.to_json("document") != "{}")
    state = F.when(F.col("value").isNull(), "missing").when(fine, "found").otherwise("broken")
    return found.select("key", F.when(fine, F.col("document")).alias("document"), state.alias("state"))


def html_table(html: str | Column) -> Column:
    """The first two rows of the first table of a page that has two, as a map of header to value, tags stripped; null without such a table."""
    text = F.col(html) if isinstance(html, str) else html
    table = F.regexp_extract(text, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " "))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip)
    head, value = cells(F.get(rows, 0)), cells(F.get(rows, 1))
    n = F.least(F.size(head), F.size(value))
    # of equal headers the last one counts
    keys, values = F.slice(head, F.lit(1), n), F.slice(value, F.lit(1), n)
    pairs = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.get(keys, i - 1).alias("k"), F.get(values, i - 1).alias("v"))), lambda p: F.array_position(F.reverse(keys), p["k"]) == n - p["i"] + 1)
    return F.when((F.size(rows) >= 2) & (n > 0), F.map_from_arrays(F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"])))


def number(text: Column, kind: str = "long") -> Column:
    """A number as pages write it, with commas between thousands; null for anything else."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast(kind)


#: Headers of the totals page with the columns and types that they fill.
TOTALS = {
    "Total Matches": ("matches", "long"), "Total 4on4": ("matches_4on4", "long"), "Total 2on2": ("matches_2on2", "long"), "Total 1on1": ("matches_1on1", "long"), "Total Time:": ("minutes", "long"),
    "Total Frags": ("frags", "long"), "FPM": ("frags_per_minute", "double"),
}


def career_totals(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and the columns of TOTALS of every page, null where a page lacks them."""
    t = pages.select(key, html_table(html).alias("__t"))
    return t.select(key, *[number(F.element_at("__t", head), kind).alias(name) for head, (name, kind) in TOTALS.items()])


def bot_games(players: DataFrame, matches: DataFrame, word: str = "bot") -> DataFrame:
    """match_id, ping_0, by_demo, by_name and players (JSON, by name) of matches whose demo or a player's name holds a word. ``matches``: match_id,
    demo_source_url; ``players``: match_id, player_name, player_ping."""
    has = lambda c: F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))
    g = players.join(matches.select("match_id", "demo_source_url"), "match_id").groupBy("match_id").agg(
        F.coalesce(F.bool_or(F.col("player_ping") == 0), F.lit(False)).alias("ping_0"), F.bool_or(has("demo_source_url")).alias("by_demo"), F.bool_or(has("player_name")).alias("by_name"),
        F.to_json(F.sort_array(F.collect_list(F.struct(F.col("player_name").alias("name"), F.col("player_ping").alias("ping"))))).alias("players"))
    return g.filter("by_demo or by_name")
