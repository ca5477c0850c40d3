"""Decisions on identities: any order and any split give what a rebuild gives; names of a stream count once."""

import random

from pyspark.sql import functions as F

from arenaflow.operators import aliases
from arenaflow.operators.graph import components
from arenaflow.streaming import canonical


def plain(decisions):
    latest = {}
    for n, a, b, accept in sorted(decisions, key=lambda d: d[0]):
        if a is not None and b is not None and a != b:
            latest[min(a, b), max(a, b)] = accept
    root = {x: x for p in latest for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), accept in latest.items():
        if accept:
            root[max(find(a), find(b))] = min(find(a), find(b))
    accepted = {x for p, ok in latest.items() if ok for x in p}
    return {x: find(x) for x in accepted}, {p for p, ok in latest.items() if not ok and find(p[0]) == find(p[1])}


def made(n, ids, seed):
    rng = random.Random(seed)
    return [(i, f"p{rng.randrange(ids):03d}", rng.choice([f"p{rng.randrange(ids):03d}"] * 20 + [None]), rng.random() < 0.7) for i in range(n)]


def as_dict(state):
    return {r.id: r.root for r in state.collect()}


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 300)]
    rows = chain + [(5, i) for i in range(6, 60)] + [(1, 1), (7, 7), (400, 401), (401, 402), (402, 400), (None, 3), (3, None)]
    got = as_dict(components(spark.createDataFrame(rows, "a long, b long")))
    assert got == {**{i: 100 for i in range(100, 301)}, **{i: 5 for i in range(5, 60)}, 1: 1, 400: 400, 401: 400, 402: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rebuild_in_any_order(spark):
    rows = made(150, 120, 1)
    state, conflicts = plain(rows)
    for shuffled in (rows, random.Random(2).sample(rows, len(rows))):
        d = spark.createDataFrame(shuffled, aliases.DECISIONS)
        assert as_dict(aliases.classes(d)) == state
        assert {(r.a, r.b) for r in aliases.conflicts(aliases.classes(d), d).collect()} == conflicts


def test_updates_equal_a_rebuild(spark):
    """Decisions in three lots, rejections of former acceptances among them: classes split and join as if all had come at once."""
    rows = made(160, 90, 3)
    rows += [(1000 + i, b, a, False) for i, (_, a, b, ok) in enumerate(rows[:60]) if ok]
    done = rows[:80]
    state = aliases.classes(spark.createDataFrame(done, aliases.DECISIONS))
    for lot in (rows[80:140], rows[140:]):
        before = as_dict(state)
        state, changed = aliases.updated(state, spark.createDataFrame(done, aliases.DECISIONS), spark.createDataFrame(lot, aliases.DECISIONS))
        done = done + lot
        want, after = plain(done)[0], as_dict(state)
        assert after == want
        moves = {x: (before.get(x, x), want.get(x, x)) for x in {*before, *want} if before.get(x, x) != want.get(x, x)}
        assert {r.id: (r.was, r.root) for r in changed.collect()} == moves


def test_only_touched_classes_are_written_again(spark):
    state = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")], "id string, root string")
    old = spark.createDataFrame([(1, "a", "b", True), (2, "x", "y", True)], aliases.DECISIONS)
    after, changed = aliases.updated(state, old, spark.createDataFrame([(3, "y", "x", False), (4, "y", "z", True)], aliases.DECISIONS))
    assert as_dict(after) == {"a": "a", "b": "a", "y": "y", "z": "y"} and {(r.id, r.was, r.root) for r in changed.collect()} == {("y", "x", "y"), ("z", "z", "y")}
    facts = spark.createDataFrame([(1, "a"), (2, "y"), (3, "z"), (4, None), (5, "x")], "n long, who string")
    assert {tuple(r) for r in aliases.moved(facts, changed, "who").collect()} == {(2, "y"), (3, "y")}
    assert {tuple(r) for r in aliases.repointed(facts, after, "who").collect()} == {(1, "a"), (2, "y"), (3, "y"), (4, None), (5, "x")}


def test_alias_list(spark):
    listed = spark.createDataFrame([("bob", "Bob!", "bobby", ["bobo", "Rob"]), ("ann", None, "", None)], aliases.ALIASES)
    players = spark.createDataFrame([("BOB", None), ("[rob]", ""), ("whoever", "bobby"), ("Ann", "x"), ("other", None), (None, "bobby")], "player_name string, player_login string")
    assert {tuple(r) for r in aliases.applied(listed, players).collect()} == {("BOB", "bob"), ("[rob]", "bob"), ("whoever", "bob"), ("Ann", "ann")}
    old = spark.createDataFrame([("ann", "old", "annlogin"), ("zed", "Zed", None)], "canonical_id string, display_name string, login string")
    assert {tuple(r) for r in aliases.upserted_displays(old, listed).collect()} == {("ann", "ann", "annlogin"), ("bob", "Bob!", "bobby"), ("zed", "Zed", None)}
    gone = spark.createDataFrame([("ann", False), ("bob", None), ("zed", True)], "canonical_id string, hidden boolean")
    facts = spark.createDataFrame([("ann",), (None,)], "canonical_id string")
    assert {r.canonical_id for r in aliases.orphans(gone, facts).collect()} == {"bob"}


NAMES = [("Milton", "m1"), ("milton.", None), ("MILTONN", None), ("Zork", None), ("zork!", None), ("Zork", "zz"), ("a b", None), ("a-b", None), ("¬¬", None), (None, "m1"), ("Anni", ""), ("Anni", "ann")]


def batches(spark, path, splits):
    known = spark.createDataFrame([("milton", "milton"), ("milton", "m1"), ("ann", "ann")], "canonical_id string, variant string")
    write = canonical.resolver(path, lambda s: known)
    schema = "player_name string, player_login string"
    for n, part in enumerate(splits):
        write(spark.createDataFrame(part, schema), n)
    write(spark.createDataFrame(splits[-1], schema), len(splits) - 1)
    return sorted(((r.raw_name, r.canonical_id) for r in canonical.read_map(spark, path).collect()), key=str)


def test_any_split_of_names_gives_one_map(spark, tmp_path):
    """A batch that runs again adds nothing. Names of one login or one normal form share an identity."""
    whole = batches(spark, str(tmp_path / "1"), [NAMES])
    by_name = dict(whole)
    assert len(whole) == len({n for n, _ in NAMES if n}) and by_name["Milton"] == by_name["milton."] == "milton" and by_name["Zork"] == by_name["zork!"] == "zork"
    assert by_name["a b"] != by_name["a-b"]
    assert [n for n, _ in batches(spark, str(tmp_path / "2"), [NAMES[:6], NAMES[6:9], NAMES[9:]])] == [n for n, _ in whole]
    assert batches(spark, str(tmp_path / "3"), [NAMES[:6], NAMES[6:9], NAMES[9:]]) == whole
    facts = spark.createDataFrame([("Zork", None), ("Milton", "kept"), ("new", None)], "player_name string, canonical_id string")
    got = {tuple(r) for r in canonical.assigned(facts, canonical.read_map(spark, str(tmp_path / "1"))).collect()}
    assert got == {("Zork", "zork"), ("Milton", "kept"), ("new", None)}


def test_stream_of_names(spark, tmp_path):
    spark.createDataFrame(NAMES, "player_name string, player_login string").repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("player_name string, player_login string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = canonical.resolver(str(tmp_path / "map"), lambda s: s.createDataFrame([("milton", "milton"), ("milton", "m1")], "canonical_id string, variant string"))
    src.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = canonical.read_map(spark, str(tmp_path / "map"))
    assert got.count() == got.select("raw_name").distinct().count() == len({n for n, _ in NAMES if n}) and got.agg(F.max("batch")).first()[0] >= 1
