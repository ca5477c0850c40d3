"""Text forms of rows, documents by key, the totals page and lists of bot games."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from arenaflow.sources import files, outputs


def test_copy_lines_round_trip(spark):
    rows = [(1, "a\tb", None, 1.5), (2, "back\\slash\\n", "line\nbreak\r", None), (3, "", "\\N", -0.25), (None, "\\\\", "\\t", 0.0)]
    schema = "id long, a string, b string, c double"
    text = outputs.copy_lines(spark.createDataFrame(rows, schema))
    assert text.first()[0] == "1\ta\\tb\t\\N\t1.5" and all("\n" not in r[0] for r in text.collect())
    assert [tuple(r) for r in outputs.from_copy_lines(text, schema).collect()] == rows
    assert outputs.from_copy_lines(spark.createDataFrame([("x\ty",)], "value string"), schema).first()[:2] == (None, "y")


def test_lines_and_boards(spark):
    df = spark.createDataFrame([(1, None, datetime(2024, 1, 2))], "id long, a string, at timestamp_ntz")
    assert json.loads(outputs.lines(df).first()[0]) == {"id": 1, "a": None, "at": "2024-01-02T00:00:00.000"}
    boards = spark.createDataFrame([("lg", 2, "b", 0.4, "40.0%"), ("lg", 1, "a", 0.5, "50.0%"), ("ddr", 1, "b", 2.0, "2.00")], "stat string, place int, canonical_id string, value double, formatted string")
    got = {r.stat: json.loads(r.document) for r in outputs.board_documents(boards).collect()}
    assert [e["canonical_id"] for e in got["lg"]["top"]] == ["a", "b"] and got["ddr"]["top"][0]["formatted"] == "2.00"


def test_documents_by_key(spark, tmp_path):
    for key, text in (("abc1", '{"n": 1}'), ("abc2", "{broken"), ("zz", '{"n": 9}')):
        (tmp_path / key[:2]).mkdir(exist_ok=True)
        (tmp_path / key[:2] / f"{key}.json").write_text(text)
    asked = spark.createDataFrame([("abc1",), ("abc2",), ("none",), ("abc1",)], "key string")
    got = {r.key: (r.document and r.document.n, r.state) for r in files.keyed_documents(asked, str(tmp_path), files.struct(n=files.T.LongType())).collect()}
    assert got == {"abc1": (1, "found"), "abc2": (None, "broken"), "none": (None, "missing")}


def test_totals_page(spark):
    page = "<p>x</p><TABLE class=a><tr><td>Total Matches</td><td> <b>FPM</b></td><td>Total Frags</td><td>Other</td></tr>\n<tr><td>1,234</td><td>3.5</td><td>n/a</td></tr></TABLE><table></table>"
    pages = spark.createDataFrame([(1, page), (2, "<table><tr><td>a</td></tr></table>"), (3, None), (4, "")], "id long, html string")
    got = {r.id: r for r in files.career_totals(pages, "id").collect()}
    assert (got[1].matches, got[1].frags_per_minute, got[1].frags, got[1].minutes) == (1234, 3.5, None, None)
    assert all(got[i].matches is None for i in (2, 3, 4))
    twice = spark.createDataFrame([("<table><tr><th>a</th><th>a</th></tr><tr><td>1</td><td>2</td></tr></table>",)], "html string")
    assert twice.select(files.html_table("html").alias("t")).first().t == {"a": "2"}


def test_bot_games(spark):
    m = spark.createDataFrame([(1, "x/BOT_game.mvd"), (2, "plain.mvd"), (3, "plain.mvd"), (4, None)], "match_id long, demo_source_url string")
    p = spark.createDataFrame([(1, "ann", 20), (1, "bob", None), (2, "frogbot", 0), (2, "ann", 5), (3, "ann", 0), (4, "robotnik", 9)], "match_id long, player_name string, player_ping int")
    got = {r.match_id: (r.ping_0, r.by_demo, r.by_name) for r in files.bot_games(p, m).collect()}
    assert got == {1: (False, True, False), 2: (True, False, True), 4: (False, False, True)}
    players = files.bot_games(p, m).filter(F.col("match_id") == 2).first().players
    assert [x["name"] for x in json.loads(players)] == ["ann", "frogbot"]
