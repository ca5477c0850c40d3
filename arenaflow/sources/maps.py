"""Files about maps, players and demos that were fetched elsewhere: sheets, entities, geometry, alias lists, features of a demo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenaflow.functions import names as N
from arenaflow.sources.files import struct

D, S, I = T.DoubleType(), T.StringType(), T.LongType()  # noqa: E741


def lat_lon(text: Column | str) -> tuple[Column, Column]:
    """Both numbers of "lat, lon"; nulls for anything else. The second is what stands after the first comma."""
    text = F.col(text) if isinstance(text, str) else text
    parts = [F.trim(F.substring_index(text, ",", 1)).try_cast("double"), F.trim(F.expr("substring(__t, instr(__t, ',') + 1)")).try_cast("double")]
    ok = (F.instr(text, ",") > 0) & parts[0].isNotNull() & parts[1].isNotNull()
    return F.when(ok, parts[0]), F.when(ok, parts[1])


def read_configs(spark: SparkSession, path: str, position: str = "geo") -> DataFrame:
    """A sheet of players' settings with a header, all columns text, and lat, lon read from the column ``position``. Cells may hold commas and line breaks in quotes."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.withColumn("__t", F.col(position))
    lat, lon = lat_lon("__t")
    return rows.withColumns({"lat": lat, "lon": lon}).drop("__t")


ENTITY = struct(type=S, kind=S, x=D, y=D, z=D, loc=S, target=S, targetName=S)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """map (the file's name) and its entities; files that aren't JSON are left out."""
    docs = spark.read.schema(struct(entities=T.ArrayType(ENTITY), _corrupt_record=S)).json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt_record")
    name = F.regexp_replace(N.basename(F.col("_metadata.file_path")), r"\.json$", "")
    return docs.select(F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("map"), "entities", "_corrupt_record").filter("_corrupt_record is null").select("map", F.coalesce("entities", F.array().cast(T.ArrayType(ENTITY))).alias("entities"))


def layouts(docs: DataFrame) -> DataFrame:
    """map, spawns, items, teles (from, to, target): a teleport's exit is the destination of its target's name (of several the last one), null where there is none. Items
    without a kind are left out; a missing z is 0."""
    at = lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), F.coalesce(e["z"], F.lit(0.0)).alias("z"), e["loc"].alias("loc"))
    of = lambda kind: F.filter("entities", lambda e: e["type"] == kind)
    named = F.filter(of("teleportDst"), lambda e: e["targetName"].isNotNull() & (e["targetName"] != ""))
    tele = lambda e: F.struct(
        at(e).alias("from"), F.element_at(F.concat(F.array(F.lit(None).cast("struct<x:double,y:double,z:double,loc:string>")), F.transform(F.filter("__dst", lambda d: d["targetName"] == e["target"]), at)), -1).alias("to"),
        e["target"].alias("target"))
    item = lambda e: F.struct(e["kind"].alias("kind"), e["x"].alias("x"), e["y"].alias("y"), F.coalesce(e["z"], F.lit(0.0)).alias("z"), e["loc"].alias("loc"))
    items = F.filter(of("item"), lambda e: e["kind"].isNotNull() & (e["kind"] != ""))
    return docs.withColumn("__dst", named).select("map", F.transform(of("spawn"), at).alias("spawns"), F.transform(items, item).alias("items"), F.transform(of("teleportSrc"), tele).alias("teles"))


def teleports(docs: DataFrame) -> DataFrame:
    """map, source, target, exit: the same links as rows, for joins."""
    return layouts(docs).select("map", F.explode("teles").alias("t")).select("map", F.col("t.from").alias("source"), "t.target", F.col("t.to").alias("exit"))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """map and geometry (vertices, faces) of a folder of files; broken ones have null geometry, so that they can be fetched again."""
    schema = struct(vertices=T.ArrayType(T.ArrayType(D)), faces=T.ArrayType(T.ArrayType(I)), _corrupt_record=S)
    docs = spark.read.schema(schema).json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt_record")
    fine = F.col("_corrupt_record").isNull() & F.col("vertices").isNotNull()
    name = F.regexp_replace(N.basename(F.col("_metadata.file_path")), r"\.json$", "")
    return docs.select(name.alias("map"), F.when(fine, F.struct("vertices", "faces")).alias("geometry"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """An alias list as JSON lines: canonical_id, display, login, variants. Lines without an id are left out."""
    schema = struct(canonical_id=S, display=S, login=S, variants=T.ArrayType(S))
    return spark.read.schema(schema).json(path).filter("canonical_id is not null")


#: Features of a demo, one JSON document a game.
FEATURES = struct(
    game_id=I, parser=I,
    damage=struct(
        byPlayer=T.MapType(S, struct(given=I, taken=I, ewep=I, byWeapon=struct(rl=I, lg=I))),
        events=T.ArrayType(struct(time=I, attacker=S, victim=S, weapon=S, damage=I, isSelf=T.BooleanType(), isSplash=T.BooleanType()))),
    los=struct(players=T.ArrayType(struct(name=S, los=T.ArrayType(struct(o=I, iv=T.ArrayType(struct(s=I, e=I))))))),
    frags=T.ArrayType(struct(time=I, killer=S, victim=S, weapon=S)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature documents as JSON lines; what doesn't parse has a null game and its text in ``_corrupt_record``."""
    schema = T.StructType(FEATURES.fields + [T.StructField("_corrupt_record", S)])
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def feature_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """totals, damage, sights and frags of feature documents, as ``combat.game_stats`` takes them. A sight of somebody beyond the list of players is
    of nobody; sights are numbered by their place in the document."""
    good = docs.filter("game_id is not null")
    t = good.select(F.col("game_id").alias("game"), F.explode("damage.byPlayer").alias("player", "b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = t.select("game", "player", zero(F.col("b.given")).alias("given"), zero(F.col("b.taken")).alias("taken"), zero(F.col("b.ewep")).alias("ewep"), zero(F.col("b.byWeapon.rl")).alias("rl_dmg"), zero(F.col("b.byWeapon.lg")).alias("lg_dmg"))
    e = good.select(F.col("game_id").alias("game"), F.explode("damage.events").alias("e"))
    damage = e.select("game", "e.time", "e.attacker", "e.victim", "e.weapon", "e.damage", F.col("e.isSelf").alias("is_self"), F.col("e.isSplash").alias("is_splash"))
    p = good.select(F.col("game_id").alias("game"), F.col("los.players.name").alias("names"), F.posexplode("los.players").alias("i", "p"))
    p = p.select("game", "names", "i", F.col("p.name").alias("looker"), F.posexplode("p.los").alias("j", "l"))
    p = p.select("game", "i", "j", "looker", F.get("names", F.col("l.o").cast("int")).alias("seen"), F.posexplode("l.iv").alias("k", "v"))
    sights = p.select(F.struct("game", "i", "j", "k").alias("id"), "game", "looker", "seen", F.col("v.s").alias("start"), F.col("v.e").alias("stop"))
    f = good.select(F.col("game_id").alias("game"), F.explode("frags").alias("f"))
    return {"totals": totals, "damage": damage, "sights": sights, "frags": f.select("game", "f.killer", "f.victim")}


def player_map(configs: DataFrame, identities: DataFrame) -> DataFrame:
    """canonical_id, nick, nationality, lat, lon, display of the players who say where they are; ``display`` falls back on the nick."""
    placed = configs.filter("nationality is not null or lat is not null")
    shown = identities.select("canonical_id", "display_name")
    return placed.join(shown, "canonical_id", "left").select("canonical_id", "nick", "nationality", "lat", "lon", F.coalesce("display_name", "nick").alias("display"))


def peak(frames: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, at and value of the highest frame of each trace; of equal ones the first."""
    best = F.max_by(F.struct(at, value), F.struct(F.col(value), -F.col(at)))
    return frames.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{at}", f"b.{value}")
