import io
import json
import math
import tarfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.functions import names as N
from arenaflow.operators import identity, ladder, rating, upserts
from arenaflow.sources import files
from arenaflow.streaming import events as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    for raw in ("Cronus", "CRONUS", "[cronus]", "au.cronus", "Ãòïîõó", " cronus. "):
        assert one(spark, N.normalised(F.lit(raw))) == "cronus", raw
    assert one(spark, N.info_string(F.lit("\\map\\dm4\\mode\\1on1"))) == {"map": "dm4", "mode": "1on1"}
    assert (one(spark, N.port(F.lit("h.example:27500 x"))), one(spark, N.port(F.lit("h.example")))) == (27500, None)
    assert one(spark, N.clean_host(F.lit("Bob@Host.Example:27500 extra"))) == "host.example:27500"


def test_scalars(spark):
    assert abs(one(spark, X.normal_cdf(F.lit(1.0))) - 0.5 * (1 + math.erf(1 / math.sqrt(2)))) < 2e-7
    assert one(spark, X.shortest_arc(F.lit(350.0), F.lit(10.0))) == -20.0
    assert (one(spark, X.money_line(F.lit(0.6))), one(spark, X.money_line(F.lit(0.4)))) == (-150, 150)
    assert one(spark, X.tier(F.lit(5.0), [9.0, 4.0])) == 2


def test_rating_properties():
    a, b = (1600.0, 200.0), (1500.0, 300.0)
    w, l = rating.posterior(a, b)
    assert w[0] > a[0] and l[0] < b[0] and w[1] <= math.hypot(a[1], rating.TAU) and l[1] <= math.hypot(b[1], rating.TAU)
    x, y = rating.duel(a, b, 0.8)
    y2, x2 = rating.duel(b, a, 0.2)
    assert all(abs(p - q) < 1e-9 for p, q in zip((*x, *y), (*x2, *y2)))




def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(stream.hourly(stream.read_events(spark, str(tmp_path / "e"), 10)), "hours")
    closed = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("hours").collect()}
    batch = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    want = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in batch.collect()}
    assert closed and all(want[k] == v for k, v in closed.items()) and len(want) - len(closed) < 30
    run(stream.once(stream.read_events(spark, str(tmp_path / "e"), 10).union(stream.read_events(spark, str(tmp_path / "e"), 10))), "once")
    assert spark.table("once").count() == e.count()
    write = stream.new_keys(str(tmp_path / "keys"), ["event_id"])
    for _ in range(2):
        write(e, 0)
    assert spark.read.parquet(str(tmp_path / "keys")).count() == e.count()


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, v string, n long")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k long, v string, n long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(upserts.replace(old, new, ["k"])) == [(1, "a", None), (2, None, 7), (3, "c", None)]
    assert rows(upserts.insert_ignore(old, new, ["k"])) == [(1, "a", None), (2, "b", 5), (3, "c", None)]
    assert rows(upserts.coalesce_update(old, new, ["k"])) == [(1, "a", None), (2, "b", 7), (3, "c", None)]
    assert rows(upserts.changed(old, old, ["k"], ["v", "n"])) == [] and rows(upserts.changed(old, new, ["k"], ["v"])) == [(2, None, 7)]
    assert rows(upserts.delete(old, new, ["k"])) == [(1, "a", None)]


def test_identity(spark):
    raw = spark.createDataFrame([("Cronus", None), ("cronuss", None), ("zz", "cronus"), ("cronux", None), ("other", None), (None, None)], "raw_name string, login string")
    known = spark.createDataFrame([("cronus", "cronus"), ("milton", "milton")], "canonical_id string, variant string")
    bad = spark.createDataFrame([("cronus", "cronux")], "canonical_id string, variant string")
    got = {r.raw_name: (r.canonical_id, r.how) for r in identity.resolve(raw, known, bad).collect()}
    assert got == {"Cronus": ("cronus", "exact"), "cronuss": ("cronus", "fuzzy"), "zz": ("cronus", "login"), "cronux": (None, "new"), "other": (None, "new"), None: (None, None)}
    ids = {r.raw_name: r.canonical_id for r in identity.minted(spark.createDataFrame([("A b",), ("a.b",), ("!",)], "raw_name string")).collect()}
    assert sorted(ids.values()) == ["a-b", "a-b-2", "player"]


def test_near_duplicate_matches(spark):
    t = datetime(2024, 1, 1)
    m = [(1, t, "dm4"), (-1, t + timedelta(minutes=9), "dm4"), (-2, t + timedelta(minutes=20), "dm4"), (5, t + timedelta(hours=5), "dm4"), (-5, t + timedelta(hours=6), "dm4"), (7, t, "dm6"), (-7, t, "dm6")]
    matches = spark.createDataFrame(m, "match_id long, match_date timestamp, match_map string")
    players = spark.createDataFrame([(i, p) for i, _, _ in m for p in ("x", "y" if i != -7 else "z")], "match_id long, canonical_id string")
    assert [tuple(r) for r in identity.near_duplicate_matches(matches, players).collect()] == [(1, -1)]


def test_ladder(spark):
    moves = spark.createDataFrame([(1, 10, 1, 1), (2, 11, 2, 1), (3, 12, 3, 1), (4, 10, 2, 2), (5, 11, 1, 2)], "id long, team_id long, to_rung int, at long")
    assert {r.team_id: r.rung for r in ladder.standings(moves).collect()} == {10: 2, 11: 1, 12: 3}
    assert {r.team_id: r.rung for r in ladder.after_win(ladder.standings(moves), 12, 11).collect()} == {12: 1, 11: 3, 10: 2}
    maps = [("a", 5, 3), ("b", None, 1), ("c", 4, 4), ("d", 9, 1), ("e", 0, 9)]
    s = spark.createDataFrame([(1, 10, 11, 10, maps), (2, 10, 12, None, [])], "id long, team_a_id long, team_b_id long, winner_id long, maps array<struct<map:string,a_frags:int,b_frags:int>>").withColumn("played_at", F.current_date())
    assert [tuple(r) for r in ladder.series_result(s).collect()] == [(1, 2, 0, "a")] and ladder.series_games(s).count() == 4
    assert {r.team_id: (r.played, r.wins) for r in ladder.records(s).collect()} == {10: (1, 1), 11: (1, 0)}
    picks = spark.createDataFrame([(1, "x", [3, 1, 2]), (1, "y", [2, 3]), (2, "x", [1]), (2, "y", [])], "id long, member string, slots array<int>")
    assert {r.id: r.slot for r in ladder.common_slot(picks).collect()} == {1: 2, 2: None}


def test_sources(spark, tmp_path):
    rec = {"match_id": 1, "date": "2024-01-02 03:04:05 +0000", "map": "dm4", "mode": "1on1", "hostname": "h:27500", "demo": "http://x/d.mvd", "players": [
        {"name": "a", "stats": {"frags": 3}, "weapons": {"rl": {"acc": {"attacks": 9}}}}, {"name": "a", "stats": {"frags": 99}}, {"name": "b"}]}
    (tmp_path / "m.json").write_text(json.dumps(rec) + "\n{broken\n")
    records = files.read_matches(spark, str(tmp_path / "m.json"))
    matches, players = files.matches_and_players(records)
    m = matches.first()
    assert matches.count() == 1 and (m.match_date, m.server_hostname, m.demo_name) == (datetime(2024, 1, 2, 3, 4, 5), "h", "d.mvd")
    assert {(r.player_name, r.player_frags, r.player_rl_attacks, r.player_lg_hits) for r in players.collect()} == {("a", 3, 9, 0), ("b", 0, 0, 0)}
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for name, text in (("a.json", "{}"), ("b.json", "{bad"), ("c.txt", "{}")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    assert [r.member for r in files.archive_members(spark, str(tmp_path / "x.tar.gz")).collect()] == ["a.json"]
    snap = spark.createDataFrame([("h:1", '[{"name":"p"}]'), ("h:2", "nope"), ("h:3", None)], "hostname string, current_players_json string")
    assert {r.hostname: r.players for r in files.parsed_servers(snap).collect()} == {"h:1": ["p"], "h:2": [], "h:3": []}


def test_entry_works_without_the_text_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "arenaflow"), tmp_path / "arenaflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'leaderboard' in e.queries() and not any(k[2:3].isdigit() or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
