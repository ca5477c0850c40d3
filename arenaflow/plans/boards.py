"""Statistics, profiles, rankings and comparisons over order lines (order = match, supplier = player) in the shape of wide player rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import joins, ladder, profiles
from arenaflow.plans.registry import Tables, query

#: Each count of a player row: a sum over the lines, different for every column.
COUNT = {c: f"CAST(floor(sum(l_quantity * {i + 2} + l_linenumber * {3 * i + 1})) AS BIGINT) % {40 + 7 * i}" for i, c in enumerate(profiles.COUNTS)}
MODES = {"F": "1on1", "O": "4on4", "P": "3on3"}
COUNTS_SQL = ", ".join(f"{e} AS {c}" for c, e in COUNT.items())
#: A null identity for some players.
PLAYERS = f"""
p AS (SELECT l_orderkey AS match_id, 'player ' || l_suppkey AS player_name, CASE WHEN l_suppkey % 29 <> 0 THEN l_suppkey END AS canonical_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'blue' ELSE 'red' END AS player_team, {COUNTS_SQL} FROM lineitem GROUP BY l_orderkey, l_suppkey),
m AS (SELECT o_orderkey AS match_id, CASE o_orderstatus WHEN 'F' THEN '1on1' WHEN 'O' THEN '4on4' ELSE '3on3' END AS match_mode, o_orderpriority AS match_map, o_orderdate AS match_date,
  CAST(o_orderkey % 4 AS INTEGER) AS match_dmm, n_name || ':' || (27500 + o_orderkey % 3) AS server_hostname FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
x AS (SELECT *, min({{'n': player_name, 'i': canonical_id, 'f': player_frags, 'ra': player_ra_taken, 'ya': player_ya_taken, 'mh': player_health100_taken, 'sf': player_spawnfrags}}) OVER w AS one FROM p WINDOW w AS (PARTITION BY match_id)),
y AS (SELECT *, min(CASE WHEN player_name <> one.n THEN {{'n': player_name, 'i': canonical_id, 'f': player_frags, 'ra': player_ra_taken, 'ya': player_ya_taken, 'mh': player_health100_taken, 'sf': player_spawnfrags}} END) OVER w AS two FROM x WINDOW w AS (PARTITION BY match_id)),
z AS (SELECT * EXCLUDE (one, two), CASE WHEN player_name = one.n THEN two ELSE one END AS opp FROM y),
q AS (SELECT * EXCLUDE (opp), opp.ra AS opp_ra, opp.ya AS opp_ya, opp.mh AS opp_mh, opp.sf AS opp_spawnfrags, opp.n AS opp_n, opp.i AS opp_i, opp.f AS opp_f FROM z),
tt AS (SELECT match_id, player_team, sum(player_frags) AS total FROM p GROUP BY 1, 2),
tr AS (SELECT a.match_id AS match_id, a.player_team AS player_team, a.total AS total, max(b.total) AS best FROM tt a JOIN tt b ON a.match_id = b.match_id AND a.player_team <> b.player_team GROUP BY 1, 2, 3),
r AS (SELECT q.*, m.* EXCLUDE (match_id), CASE WHEN match_mode = '1on1' THEN CASE WHEN opp_n IS NOT NULL THEN CASE WHEN player_frags > opp_f THEN 'win' WHEN player_frags < opp_f THEN 'loss' ELSE 'draw' END END
    ELSE CASE WHEN total > best THEN 'win' WHEN total < best THEN 'loss' WHEN total = best THEN 'draw' END END AS outcome,
    CASE WHEN match_mode = '1on1' THEN coalesce(CAST(opp_i AS VARCHAR), opp_n) END AS opponent, CASE WHEN match_mode = '1on1' THEN opp_f END AS opponent_frags,
    split_part(server_hostname, ':', 1) AS server, printf('%d-%02d', isoyear(match_date), weekofyear(match_date)) AS week
  FROM q JOIN m USING (match_id) LEFT JOIN tr USING (match_id, player_team) WHERE match_mode <> '3on3')
"""


def players(t: Tables) -> DataFrame:
    # dealt once by match, before the wide rows are made: they need no other shuffle until they leave the match, and all branches share this one
    lines = joins.by_match(t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber"), "l_orderkey")
    g = lines.groupBy("l_orderkey", "l_suppkey").agg(*[F.expr(e).alias(c) for c, e in COUNT.items()])
    who = F.col("l_suppkey")
    return g.select(
        F.col("l_orderkey").alias("match_id"), F.concat(F.lit("player "), who.cast("string")).alias("player_name"), F.when(who % 29 != 0, who).alias("canonical_id"),
        F.when(who % 2 == 0, "blue").otherwise("red").alias("player_team"), *COUNT)


def matches(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(n, "c_nationkey")
    mode = F.when(F.col("o_orderstatus") == "F", "1on1").when(F.col("o_orderstatus") == "O", "4on4").otherwise("3on3")
    return o.select(
        F.col("o_orderkey").alias("match_id"), mode.alias("match_mode"), F.col("o_orderpriority").alias("match_map"), F.col("o_orderdate").alias("match_date"),
        (F.col("o_orderkey") % 4).cast("int").alias("match_dmm"), F.concat("n_name", F.lit(":"), (27500 + F.col("o_orderkey") % 3).cast("string")).alias("server_hostname"))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: X.rounded(F.col(c).cast("double"), digits) for c in columns})


def rounds(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE) + 1e-9, {digits}) AS {c}" for c, e in columns.items())


STAT_SQL = f"s AS (SELECT canonical_id, count(*) AS matches, {rounds({n: s[2] for n, s in profiles.STATS.items()})} FROM q JOIN m USING (match_id) WHERE match_mode = '1on1' AND canonical_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)"


def stats(t: Tables) -> DataFrame:
    return rounded(profiles.stat_table(players(t), matches(t), least=10), list(profiles.STATS))


@query(f"WITH {PLAYERS}, {STAT_SQL} SELECT * FROM s")
def stat_table(t: Tables):
    """All thirteen statistics of every player with enough duels."""
    return stats(t)


@query(f"""
WITH {PLAYERS}, {STAT_SQL}, u AS ({" UNION ALL ".join(f"SELECT canonical_id, '{n}' AS stat, {n} AS value, {'' if s[0] == 'asc' else '-'}{n} AS k FROM s WHERE {n} IS NOT NULL" for n, s in profiles.STATS.items())})
SELECT stat, CAST(row_number() OVER (PARTITION BY stat ORDER BY k, canonical_id) AS INTEGER) AS place, canonical_id, value FROM u QUALIFY place <= 5
""")
def stat_leaderboards(t: Tables):
    """The five best of each statistic, in its direction."""
    return profiles.leaderboards(stats(t)).drop("formatted")


MEASURES_SQL = (
    "count(*) AS matches, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'draw') AS draws, "
    + rounds({"win_rate": "count(*) FILTER (outcome = 'win') / count(*)"} | {n: f"avg({e})" for n, e in profiles.AVERAGES.items()})
)
CUT = {"career": "''", "mode": "match_mode", "map": "match_mode || ',' || match_map", "dmm": "match_mode || ',' || match_dmm", "server": "server", "opponent": "opponent", "week": "match_mode || ',' || week"}
SLICED_SQL = lambda cuts, rows, measures: " UNION ALL ".join(f"SELECT canonical_id, '{s}' AS slice, {CUT[s]} AS member, {measures} FROM {rows} WHERE canonical_id IS NOT NULL AND {CUT[s]} IS NOT NULL GROUP BY 1, 2, 3" for s in cuts)


@query(f"WITH {PLAYERS} {SLICED_SQL(list(profiles.SLICES), 'r', MEASURES_SQL + ', ' + rounds({'avg_margin': 'avg(player_frags - opponent_frags)'}) + ', min(match_date) AS first_match, max(match_date) AS last_match')}")
def profile_slices(t: Tables):
    """The whole profile of every player: career, modes, maps, settings, servers, opponents and weeks with 31 averages, from one scan."""
    rows = profiles.outcomes(players(t), matches(t))
    return rounded(profiles.profiles(rows, parts=joins.parts(t.lineitem)), ["win_rate", *profiles.AVERAGES, "avg_margin"])


@query(f"""
WITH {PLAYERS}, c AS ({SLICED_SQL(["mode", "opponent"], "(SELECT * FROM r WHERE match_date >= DATE '2000-07-04' AND match_date < DATE '2000-12-31')", MEASURES_SQL)}),
b AS ({SLICED_SQL(["mode", "opponent"], "(SELECT * FROM r WHERE match_date >= DATE '2000-01-06' AND match_date < DATE '2000-07-04')", MEASURES_SQL)})
SELECT coalesce(c.canonical_id, b.canonical_id) AS canonical_id, coalesce(c.slice, b.slice) AS slice, coalesce(c.member, b.member) AS member, c.matches AS matches, c.win_rate AS win_rate, c.avg_frags AS avg_frags, c.avg_ping AS avg_ping,
  b.matches AS matches_before, b.win_rate AS win_rate_before, b.avg_frags AS avg_frags_before, b.avg_ping AS avg_ping_before
FROM c FULL JOIN b ON b.canonical_id = c.canonical_id AND b.slice = c.slice AND b.member = c.member
""")
def profile_change(t: Tables):
    """The last half year beside the one before it."""
    rows = profiles.profile_change(profiles.outcomes(players(t), matches(t)), datetime(2000, 12, 31), 180)
    shown = ["matches", "win_rate", "avg_frags", "avg_ping"]
    out = rows.select("canonical_id", "slice", "member", *shown, *[f"{c}_before" for c in shown])
    return rounded(out, [f"{c}{b}" for c in shown[1:] for b in ("", "_before")])


#: Stand-ins of ratings from a player's own rows.
RATINGS_SQL = """
g AS (SELECT canonical_id, round(1500 + 8 * avg(player_frags - player_deaths), 4) AS mu, round(60 + 400 / sqrt(count(*)) + 1e-9, 4) AS sigma, count(*) AS games, count(*) FILTER (outcome = 'win') AS wins, count(DISTINCT opponent) AS opponents,
  canonical_id % 17 = 0 AS hidden FROM r WHERE match_mode = '1on1' AND canonical_id IS NOT NULL GROUP BY 1)
"""


def ratings(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    d = rows.filter("match_mode = '1on1' and canonical_id is not null")
    return d.groupBy("canonical_id", *keys).agg(
        F.round(1500 + 8 * F.avg(F.col("player_frags") - F.col("player_deaths")), 4).alias("mu"), X.rounded(60 + 400 / F.sqrt(F.count("*")), 4).alias("sigma"), F.count("*").alias("games"),
        F.count_if(F.col("outcome") == "win").alias("wins"), F.countDistinct("opponent").alias("opponents")).withColumn("hidden", F.col("canonical_id") % 17 == 0)


@query(f"""
WITH {PLAYERS}, {RATINGS_SQL}, l AS (SELECT canonical_id, max(match_date) AS last_match, count(*) FILTER (match_date >= DATE '2001-05-03') AS recent FROM p JOIN m USING (match_id) WHERE match_mode = '1on1' AND canonical_id IS NOT NULL GROUP BY 1),
o AS (SELECT mu, row_number() OVER (ORDER BY mu) - 1 AS place, count(*) OVER () AS n FROM g WHERE games >= 10),
k AS (SELECT mu AS cutoff FROM o, (VALUES (0.95::DOUBLE), (0.8::DOUBLE), (0.5::DOUBLE), (0.2::DOUBLE)) v(share) WHERE n >= 10 AND place = floor(share * n)),
a AS (SELECT g.*, last_match, coalesce(recent, 0) AS recent, sqrt(sigma * sigma + power(0.5 * greatest(0.0, date_diff('day', CAST(last_match AS DATE), DATE '2001-08-01') - 30), 2)) AS now FROM g LEFT JOIN l USING (canonical_id) WHERE games >= 5 AND NOT hidden),
b AS (SELECT *, now > 150 OR opponents < 10 AS provisional FROM a)
SELECT canonical_id, mu, sigma, round(now + 1e-9, 6) AS sigma_now, round(mu - 3 * now + 1e-9, 6) AS conservative, games, opponents, provisional, round(wins / games + 1e-9, 6) AS win_rate, last_match, recent,
  CASE WHEN (SELECT count(*) FROM k) > 0 THEN 1 + (SELECT count(*) FROM k WHERE cutoff > mu) END AS tier,
  CASE WHEN NOT provisional THEN CAST(sum(CASE WHEN provisional THEN 0 ELSE 1 END) OVER (ORDER BY mu DESC, canonical_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS place
FROM b QUALIFY row_number() OVER (ORDER BY mu DESC, canonical_id) <= 500
""")
def rankings(t: Tables):
    """The ranking of a mode in one query."""
    p, m = players(t), matches(t)
    out = profiles.rankings(ratings(profiles.outcomes(p, m)), p, m, datetime(2001, 8, 1))
    return rounded(out, ["sigma_now", "conservative", "win_rate"])


PAIR_SQL = """
e AS (SELECT match_id, canonical_id AS id, sum(player_frags) AS f, sum(player_damage_given) AS dg, sum(player_damage_taken) AS dt FROM p WHERE canonical_id IS NOT NULL GROUP BY 1, 2),
h AS (SELECT a.id AS id_a, b.id AS id_b, a.f AS fa, b.f AS fb, a.dg AS ga, a.dt AS ta, b.dg AS gb, b.dt AS tb, match_map, match_date FROM e a JOIN e b ON a.match_id = b.match_id AND a.id < b.id JOIN m ON m.match_id = a.match_id WHERE match_mode = '1on1')
"""
RECORD_SQL = """count(*) AS matches, count(*) FILTER (fa > fb) AS wins_a, count(*) FILTER (fb > fa) AS wins_b, count(*) FILTER (fa = fb) AS draws, max(match_date) AS last_match,
  round(sum(ga) / nullif(sum(ta), 0) + 1e-9, 6) AS ddr_a, round(sum(gb) / nullif(sum(tb), 0) + 1e-9, 6) AS ddr_b"""
#: Abramowitz and Stegun 7.1.26, as in the Column.
CDF_SQL = """0.5 * (1 + sign(z) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)))"""
CHANCE_SQL = f"(SELECT {CDF_SQL} FROM (SELECT z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM (SELECT (x.mu - y.mu) / sqrt(2 * 62500.0 + x.sigma * x.sigma + y.sigma * y.sigma) AS z)))"


@query(f"""
WITH {PLAYERS}, {RATINGS_SQL}, {PAIR_SQL}, w AS (SELECT id_a, id_b, {RECORD_SQL} FROM h GROUP BY 1, 2),
c AS (SELECT w.*, (x.mu - y.mu) / sqrt(2 * 62500.0 + x.sigma * x.sigma + y.sigma * y.sigma) AS z FROM w LEFT JOIN g x ON x.canonical_id = id_a LEFT JOIN g y ON y.canonical_id = id_b),
d AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM c), v AS (SELECT *, {CDF_SQL} AS p FROM d)
SELECT id_a, id_b, matches, wins_a, wins_b, draws, last_match, ddr_a, ddr_b, round(CASE WHEN wins_a + wins_b >= 10 THEN ((wins_a + wins_b) * (wins_a / (wins_a + wins_b)) + 8 * p) / (wins_a + wins_b + 8) ELSE p END + 1e-9, 6) AS chance_a FROM v
""")
def head_to_head(t: Tables):
    """Record, damage and blended chance of every pair that has met."""
    p, m = players(t), matches(t)
    return rounded(profiles.head_to_head(profiles.meetings(p, m), ratings(profiles.outcomes(p, m))), ["ddr_a", "ddr_b", "chance_a"])


@query(f"""
WITH {PLAYERS}, {PAIR_SQL}, {RATINGS_SQL.replace("SELECT canonical_id, round(1500", "SELECT canonical_id, match_map, round(1500").replace("GROUP BY 1)", "GROUP BY 1, 2)")},
k AS (SELECT match_map FROM m WHERE match_mode = '1on1' GROUP BY 1 ORDER BY count(*) DESC, match_map LIMIT 3), w AS (SELECT id_a, id_b, match_map, {RECORD_SQL} FROM h WHERE match_map IN (SELECT * FROM k) GROUP BY 1, 2, 3),
c AS (SELECT w.*, (x.mu - y.mu) / sqrt(2 * 62500.0 + x.sigma * x.sigma + y.sigma * y.sigma) AS z FROM w LEFT JOIN g x ON x.canonical_id = id_a AND x.match_map = w.match_map LEFT JOIN g y ON y.canonical_id = id_b AND y.match_map = w.match_map),
d AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM c)
SELECT id_a, id_b, match_map, matches, wins_a, wins_b, draws, last_match, ddr_a, ddr_b, round({CDF_SQL} + 1e-9, 6) AS chance_a FROM d
""")
def head_to_head_maps(t: Tables):
    """The same by map, on the maps that are played most."""
    p, m = players(t), matches(t)
    out = profiles.head_to_head_maps(profiles.meetings(p, m), ratings(profiles.outcomes(p, m), ("match_map",)), m, pool=3)
    return rounded(out, ["ddr_a", "ddr_b", "chance_a"])


@query(f"""
WITH {PLAYERS}, s AS (SELECT canonical_id, {rounds(profiles.AXES)} FROM p JOIN m USING (match_id) WHERE match_mode = '1on1' AND match_date >= DATE '2000-01-01' AND canonical_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)
{" UNION ALL ".join(f"SELECT '{a}' AS axis, min({a}) AS low, max({a}) AS high FROM s" for a in profiles.AXES)}
""")
def axis_ranges(t: Tables):
    """The population's range on each axis of the skill profile."""
    return rounded(profiles.axis_ranges(players(t), matches(t), datetime(2000, 1, 1)), ["low", "high"])


@query(f"""
WITH {PLAYERS}, s AS (SELECT p.canonical_id AS canonical_id, count(*) AS matches, {", ".join(f"{e} AS {c}" for c, e in profiles.CARDS.items())}
  FROM p JOIN m USING (match_id) JOIN (SELECT match_id, player_name AS other, player_ra_taken AS opp_ra, player_health100_taken AS opp_mh FROM p) o ON o.match_id = p.match_id AND other <> player_name
  WHERE match_mode = '1on1' AND p.canonical_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
u AS ({" UNION ALL ".join(f"SELECT canonical_id, matches, '{c}' AS card, {c} AS raw0 FROM s WHERE {c} IS NOT NULL" for c in profiles.CARDS)}),
v AS (SELECT canonical_id, card, round(raw0, 9) AS raw, count(*) OVER w AS n, round((matches * round(raw0, 9) + 150 * avg(raw0) OVER w) / (matches + 150), 9) AS shrunk FROM u WINDOW w AS (PARTITION BY card)),
f AS (SELECT a.canonical_id AS canonical_id, a.card AS card, CASE WHEN any_value(a.n) >= 2 THEN CAST(round_even(99.0 * count(*) FILTER (b.raw < a.shrunk) / (any_value(a.n) - 1), 0) AS INTEGER) END AS rating FROM v a JOIN v b ON b.card = a.card GROUP BY a.canonical_id, a.card)
SELECT canonical_id, any_value(matches) AS matches, {", ".join(f"max(rating) FILTER (card = '{c}') AS {c}" for c in profiles.CARDS)}, CAST(round_even(avg(rating), 0) AS INTEGER) AS overall FROM f JOIN s USING (canonical_id) GROUP BY 1
""")
def rating_cards(t: Tables):
    """Cards of 0 to 99: aim and control among the established players."""
    return profiles.cards(players(t), matches(t))


#: A map of each line: its frags for the customer's and the supplier's side.
SERIES_SQL = "g AS (SELECT l_orderkey AS id, l_linenumber AS game, l_returnflag || l_linestatus AS map, CAST(l_quantity AS INTEGER) AS a, CAST(l_partkey % 50 AS INTEGER) AS b FROM lineitem)"


def series(t: Tables) -> DataFrame:
    game = F.struct(F.col("l_linenumber").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("map"), F.col("l_quantity").cast("int").alias("a_frags"), (F.col("l_partkey") % 50).cast("int").alias("b_frags"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(game)).alias("maps"))  # an order has seven lines at most
    return lines.select("id", F.transform("maps", lambda m: F.struct(m["map"].alias("map"), m["a_frags"].alias("a_frags"), m["b_frags"].alias("b_frags"))).alias("maps"))


@query(f"""
WITH {SERIES_SQL}, c AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (a > b) OVER w AS x, count(*) FILTER (b > a) OVER w AS y FROM g WINDOW w AS (PARTITION BY id ORDER BY game, map, a, b ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, coalesce(max(CAST(greatest(x, y) >= 2 AS INTEGER)) OVER (PARTITION BY id ORDER BY game, map, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
s AS (SELECT map, count(*) AS played, count(*) FILTER (n = 1) AS first_pick, count(*) FILTER (greatest(x, y) >= 2 AND before = 0) AS decider, round(avg(a + b) + 1e-9, 6) AS avg_total FROM d GROUP BY 1)
SELECT *, round(100.0::DOUBLE * played / sum(played) OVER (), 1) AS played_pct, round(100.0::DOUBLE * first_pick / sum(first_pick) OVER (), 1) AS first_pick_pct, round(100.0::DOUBLE * decider / sum(decider) OVER (), 1) AS decider_pct FROM s
""")
def ladder_maps(t: Tables):
    """How often each map is played, picked first and decides a series."""
    return rounded(ladder.map_stats(series(t)), ["avg_total"])


@query(f"""
WITH {SERIES_SQL}, m AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY game, map, a, b) - 1 AS game, map, abs(a - b) AS margin FROM g),
u AS (SELECT 'closest' AS kind, *, margin AS o FROM m UNION ALL SELECT 'widest', *, -margin FROM m)
SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY o, id, game) AS INTEGER) AS place, id, CAST(game AS INTEGER) AS game, map, margin FROM u QUALIFY place <= 5
""")
def ladder_margins(t: Tables):
    """The closest and the widest games."""
    return ladder.margins(series(t))


LADDER_SQL = (
    ", ".join(f"round(avg({n}) + 1e-9, 1) AS {n}" for n in ("frags", "deaths", "suicides", "tk", "dmg_given", "dmg_taken", "ya", "ra", "mh", "quad"))
    + ", "
    + ", ".join(f"coalesce(round(100.0::DOUBLE * sum({n}0) / nullif(sum({n}1), 0) + 1e-9, 1), 0) AS {n}" for n in ("eff", "sg", "lg", "rl"))
)


def ladder_query_sql(keys: str, rows: str) -> str:
    sums = ", ".join([f"sum(coalesce({e}, 0)) AS {n}" for n, e in ladder.AVERAGED.items()] + [f"sum(coalesce({e}, 0)) AS {n}{i}" for n, pair in ladder.SHARED.items() for i, e in enumerate(pair)])
    return f"SELECT {keys}, count(*) AS maps, {LADDER_SQL} FROM (SELECT {keys}, match_id, {sums} FROM ({rows}) GROUP BY {keys}, match_id) GROUP BY {keys}"


@query(f"WITH {PLAYERS} {ladder_query_sql('team_id', 'SELECT p.*, s_nationkey AS team_id FROM p JOIN supplier ON s_suppkey = canonical_id JOIN m USING (match_id) WHERE match_dmm = 1')}")
def ladder_teams(t: Tables):
    """Teams (nations of suppliers) over the games of their matches: averages of a game and shares of sums."""
    p, games = players(t), matches(t).filter("match_dmm = 1").select(F.col("match_id").alias("game_id"))
    rows = p.join(games, p.match_id == games.game_id)
    teams = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("team_id")).agg(F.collect_list("s_suppkey").alias("members"))  # a roster
    home = t.supplier.select(F.col("s_suppkey").alias("canonical_id"), F.col("s_nationkey").cast("long").alias("team"))
    sides = rows.join(home, "canonical_id").select("game_id", "team").distinct()
    played = sides.select(F.col("team").alias("team_a_id"), F.col("team").alias("team_b_id"), F.array("game_id").alias("game_ids"))
    return ladder.team_stats(teams, played, rows).filter("maps > 0")


@query(f"WITH {PLAYERS}, k AS ({ladder_query_sql('canonical_id', 'SELECT p.* FROM p JOIN m USING (match_id) WHERE match_dmm = 1 AND canonical_id IS NOT NULL')}) SELECT k.*, CAST(s_nationkey AS BIGINT) AS team_id FROM k JOIN supplier ON s_suppkey = canonical_id")
def ladder_players(t: Tables):
    """The same for players."""
    p, games = players(t), matches(t).filter("match_dmm = 1").select(F.col("match_id").alias("game_id"))
    teams = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("team_id")).agg(F.collect_list("s_suppkey").alias("members"))
    played = games.select(F.lit(0).alias("team_a_id"), F.lit(1).alias("team_b_id"), F.array("game_id").alias("game_ids"))
    return ladder.player_stats(teams, played, p.join(games, p.match_id == games.game_id))
