"""Range lookup against a scan of all ranges, and what hosts get from addresses, names or neither."""

import ipaddress
import random

from pyspark.sql import functions as F

from arenaflow.operators import places


def number(ip):
    try:
        parts = [int(p) for p in ip.split(".")]
        return sum(p << s for p, s in zip(parts, (24, 16, 8, 0))) if len(parts) == 4 and all(0 <= p <= 255 and len(t) <= 3 for p, t in zip(parts, ip.split("."))) else None
    except (ValueError, AttributeError):
        return None


def test_blocks_cover_a_range_once(spark):
    rng = random.Random(1)
    ranges = [(0, 2**32 - 1), (5, 5), (0, 0), (2**32 - 1, 2**32 - 1), (1, 2), (7, 8)] + [tuple(sorted(rng.sample(range(500), 2))) for _ in range(60)]
    df = spark.createDataFrame(ranges, "a long, b long").select("a", "b", places.range_blocks(F.col("a"), F.col("b")).alias("k"))
    for r in df.collect():
        spans = sorted((k.block << k.level, (k.block + 1 << k.level) - 1) for k in r.k)
        assert spans[0][0] == r.a and spans[-1][1] == r.b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:])) and len(spans) <= 62


def test_smallest_range_wins(spark):
    rng = random.Random(2)
    ip = lambda n: str(ipaddress.ip_address(n))
    spans = [tuple(sorted(rng.choices([rng.randrange(2**32), rng.randrange(4096)], k=2))) for _ in range(40)] + [(100, 200), (100, 200), (0, 2**32 - 1), (300, 250)]
    ranges = [(ip(a), ip(b), f"c{i:02d}") for i, (a, b) in enumerate(spans)] + [("1.2.3", "9.9.9.9", "bad"), (None, "9.9.9.9", "bad")]
    asked = [ip(rng.choice([rng.randrange(2**32), rng.randrange(5000), *rng.choice(spans)])) for _ in range(300)] + [None, "", "1.2.3", "1.2.3.256", "a.b.c.d", "1.2.3.4.5", "01.2.3.4", "1.2.3.-4", "1111.2.3.4"]
    got = places.located(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id long, ip string"), spark.createDataFrame(ranges, "first string, last string, country string")).collect()
    assert len(got) == len(asked)
    for r in got:
        n = number(asked[r.id])
        inside = [] if n is None else [(b - a, a, f"c{i:02d}") for i, (a, b) in enumerate(spans) if a <= n <= b]
        assert r.country == (min(inside)[2] if inside else None), asked[r.id]
    assert places.located(spark.createDataFrame([("1.1.1.1",)], "ip string"), spark.createDataFrame([], "first string, last string, country string")).first().country is None


def test_cascade_of_hosts(spark):
    hosts = spark.createDataFrame([("a.example",), ("b.example",), ("msk.example",), ("gone.example",), ("a.example",), ("msk2.example",)], "hostname string")
    names = spark.createDataFrame([("a.example", "10.0.0.1"), ("b.example", "11.0.0.1"), ("msk2.example", "11.0.0.2")], "hostname string, ip string")
    ranges = spark.createDataFrame([("10.0.0.0", "10.0.0.255", "SE", "EU", "Lund", 55.7, 13.2)], "first string, last string, country string, region string, city string, lat double, lon double")
    hint = F.when(F.col("hostname").startswith("msk"), F.struct(F.lit("RU").alias("country"), F.lit("EU").alias("region")))
    got = {r.hostname: (r.country, r.region, r.city, r.error) for r in places.geolocated(hosts, names, ranges, hint).collect()}
    assert got == {
        "a.example": ("SE", "EU", "Lund", None), "b.example": (None, None, None, "lookup_failed"), "msk.example": ("RU", "EU", None, "dns_failed_name_hint"),
        "gone.example": (None, None, None, "dns_failed"), "msk2.example": ("RU", "EU", None, "lookup_failed"),
    }
