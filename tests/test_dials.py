"""Dials of a track, discipline, win splits and key resolution against plain Python."""

import math
import random
import statistics

from pyspark.sql import functions as F

from arenaflow.functions import exprs as X
from arenaflow.operators import frames, identity, upserts


def percentile(v, q):
    v = sorted(v)
    i = q * (len(v) - 1)
    lo, hi = math.floor(i), math.ceil(i)
    return v[lo] * (1 - (i - lo)) + v[hi] * (i - lo) if lo != hi else v[lo]


def plain(samples):
    """Dials of one track, written from their description."""
    arc = lambda d: (d + 180) % 360 - 180
    speeds, up, turns, pairs, steps, heading = [], [], [], [], [], None
    for (t0, x0, y0, z0, a0), (t1, x1, y1, z1, a1) in zip(samples, samples[1:]):
        dt = t1 - t0
        if dt <= 0:
            continue
        vx, vy, vz = (x1 - x0) / dt, (y1 - y0) / dt, (z1 - z0) / dt
        v = math.hypot(vx, vy)
        if v > 5000 or abs(vz) > 5000:
            heading = None
            continue
        speeds.append(v)
        up.append(vz)
        turns.append(arc(a1 - a0) / dt)
        steps.append((v, dt))
        new = math.degrees(math.atan2(vy, vx)) if v >= 50 else None
        if new is not None and heading is not None:
            pairs.append((turns[-1], arc(new - heading) / dt))
        heading = new
    if not speeds:
        return None
    jumps = sum(b > 200 and not (i and up[i - 1] > 200) for i, b in enumerate(up))
    pauses, run = [], 0.0
    for v, dt in [*steps, (1e9, 0)]:
        if v < 30:
            run += dt
        else:
            if run >= 0.30:
                pauses.append(run)
            run = 0.0
    xs, ys = zip(*pairs) if pairs else ((), ())
    r = statistics.correlation(xs, ys) if len(pairs) > 1 and len(set(xs)) > 1 and len(set(ys)) > 1 else 0.0
    return [statistics.fmean(speeds), *(percentile(speeds, q) for q in (0.5, 0.95, 0.99)), 100 * sum(abs(v) > 40 for v in up) / len(up), jumps, len(pauses), sum(pauses),
            *(percentile([abs(t) for t in turns], q) for q in (0.5, 0.95)), r, len(pairs)]


def test_track_dials(spark):
    rng = random.Random(1)
    tracks = {}
    for p in range(6):
        t, x, y, z, yaw, out = 0.0, 0.0, 0.0, 0.0, 0.0, []
        for i in range(300):
            still = (i // 25) % 3 == p % 3
            out.append((round(t, 4), x, y, z, yaw))
            t += rng.choice([0.013, 0.05, 0.1]) if i % 50 else 0.0
            x, y, z = (x, y, z) if still else (x + rng.gauss(8, 6), y + rng.gauss(0, 6), z + rng.choice([0, 0, 30, -30]))
            if i == 150:
                x += 9000
            yaw = (yaw + rng.gauss(0, 9)) % 360
        # of equal times the first stays: the others make no step
        tracks[p] = [s for i, s in enumerate(out) if i == 0 or s[0] > out[i - 1][0]]
    tracks[7] = [(0.0, 0.0, 0.0, 0.0, 0.0)]
    tracks[8] = [(0.0, 0.0, 0.0, 0.0, 0.0), (0.01, 9e6, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(p, *s) for p, ss in tracks.items() for s in ss], "p long, t double, x double, y double, z double, yaw double")
    got = {r.p: r for r in frames.track_dials(df, ["p"], "t").collect()}
    assert 7 not in got and got[8].speed_mean is None and got[8].frames == 2
    for p in range(6):
        r, w = got[p], plain(tracks[p])
        mine = [r.speed_mean, r.speed_p50, r.speed_p95, r.speed_p99, r.airborne_pct, r.jumps, r.pauses, r.paused, r.turn_p50, r.turn_p95, r.coupling, r.coupled]
        assert all(abs(a - b) <= tol for a, b, tol in zip(mine, w, [0.0051] * 4 + [0.051, 0, 0, 0.0051, 0.051, 0.051, 0.00051, 0])), (p, mine, w)


def test_discipline(spark):
    df = spark.createDataFrame([(1, 200.0, 100.0, 50.0, 120.0), (2, 100.0, 130.0, None, 1.0), (3, None, 1.0, 1.0, 1.0), (4, 182.0, 100.0, 1.0, 1.0)], "p long, own_kill double, enemy_kill double, own_death double, enemy_death double")
    got = {r.p: (r.kill_lead, r.death_deficit, r.below, r.priority) for r in frames.discipline(df).collect()}
    assert got == {1: (100.0, -70.0, False, 0.0), 2: (-30.0, None, True, round(112 / 82 * 2, 3)), 4: (82.0, 0.0, False, 0.0)}


def test_win_split(spark):
    df = spark.createDataFrame([("a", "W", 10.0, 3, 4), ("a", "W", 20.0, 0, 0), ("a", "L", None, 1, 10), ("a", "D", 30.0, 5, 6), ("b", "L", 1.0, None, 0)], "p string, result string, v double, mine int, total int")
    got = {r.p: r for r in frames.win_split(df, ["p"], ["v"], {"share": ("mine", "total")}).collect()}
    a, b = got["a"], got["b"]
    assert (a.games, a.wins, a.losses, a.v_win, a.v_loss, a.v_all) == (4, 2, 1, 15.0, None, 20.0) and (a.share_win, a.share_loss, a.share_all) == (0.75, 0.1, 0.45)
    assert (b.v_win, b.share_loss, b.v_loss) == (None, None, 1.0)


def test_keys_of_a_group(spark):
    known = [(1, "BLooD_DoG(D_P)"), (1, "ann"), (1, "Ann"), (1, "bo"), (2, "ann"), (1, "zed zed")]
    wanted = [(1, "ann"), (1, "ANN"), (1, "blood_dog(d_p"), (1, "BLooD"), (1, "b o"), (1, "zedz"), (1, "zedzedzed"), (1, "an"), (1, "###"), (2, "blood_dog"), (1, "bother")]
    got = {(r.group, r.name): (r.key, r.kind) for r in identity.resolve_key(spark.createDataFrame(wanted, "group long, name string"), spark.createDataFrame(known, "group long, key string")).collect()}
    assert got == {
        (1, "ann"): ("ann", 0), (1, "ANN"): ("Ann", 1), (1, "blood_dog(d_p"): ("BLooD_DoG(D_P)", 2), (1, "BLooD"): ("BLooD_DoG(D_P)", 3), (1, "b o"): ("bo", 2), (1, "zedz"): ("zed zed", 3),
        (1, "zedzedzed"): ("zed zed", 3), (1, "an"): (None, None), (1, "###"): (None, None), (2, "blood_dog"): (None, None), (1, "bother"): (None, None),
    }


def test_small_expressions(spark):
    one = spark.range(1).select(X.angle16(F.lit(16384)).alias("a"), X.estimated_ping(F.lit(1000.0)).alias("p"), X.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("h")).first()
    assert one.a == 90.0 and one.p == 45.0 and abs(one.h - math.pi * 6371) < 1e-6


def test_last_of_a_batch_and_display_names(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (None, 1, "d"), (None, 2, "e")], "id long, at long, v string")
    assert {(r.id, r.v) for r in upserts.last_wins(df, ["id"], [F.desc("at")]).collect()} == {(1, "b"), (2, "c"), (None, "e")}
    seen = spark.createDataFrame([("x", "plain")] * 2 + [("x", "dëco")] * 5 + [("y", "só")] * 3 + [("y", "ñó")], "canonical_id string, raw_name string")
    assert {(r.canonical_id, r.display_name) for r in identity.display_names(seen).collect()} == {("x", "plain"), ("y", "só")}
