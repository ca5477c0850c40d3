"""Where addresses are: a lookup in ranges, and the cascade over what is known of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32


def address_number(ip: Column | str) -> Column:
    """The number of a dotted address of four parts from 0 to 255; null for anything else."""
    text = F.col(ip) if isinstance(ip, str) else ip
    parts = [F.split_part(text, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    fine = text.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.greatest(*parts).between(0, 255)
    return F.when(fine, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def range_blocks(first: Column, last: Column) -> Column:
    """A range as at most two aligned blocks of 2 ** level addresses for each level: array of (level, block)."""

    def at(level: Column) -> Column:
        size = F.expr("1L") * F.pow(F.lit(2), level).cast("long")
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        block = lambda b, ok: F.when(ok & (low < high), F.struct(level.cast("int").alias("level"), b.alias("block")))
        return F.array(block(low, low % 2 == 1), block(high - 1, high % 2 == 1))

    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), at))
    return F.filter(whole, lambda b: b.isNotNull())


def located(addresses: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """``addresses`` with the columns of the range that holds their ``ip``: of several the smallest, then the one that begins first, then the smallest row. ``ranges``
    has first and last (addresses, both inside) and columns of its own, of which none may be in ``addresses``; ranges may nest and overlap. Null and malformed addresses, and
    those in no range, get nulls; ranges with such a bound or turned round hold nothing.

    Each range becomes at most 62 aligned blocks and each different address has one block a level, so the lookup is an equi join on level
    and block, over the levels that occur: nothing is compared with all ranges."""
    own = [c for c in ranges.columns if c not in ("first", "last")]
    bounds = ranges.select(address_number("first").alias("__a"), address_number("last").alias("__b"), F.struct(*own).alias("__row")).filter("__a <= __b")
    blocks = bounds.select("__a", "__b", "__row", F.explode(range_blocks(F.col("__a"), F.col("__b"))).alias("k")).select("__a", "__b", "__row", "k.level", "k.block")
    levels = sorted(r.level for r in blocks.select("level").distinct().collect())  # 33 at most
    different = addresses.select(ip).distinct().withColumn("__n", address_number(ip)).filter("__n is not null")
    keys = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright("__n", v).alias("block")) for v in levels]).cast("array<struct<level:int,block:bigint>>")
    asked = different.select(ip, F.explode(keys).alias("k")).select(ip, "k.level", "k.block")
    best = asked.join(blocks, ["level", "block"]).groupBy(ip).agg(F.min(F.struct((F.col("__b") - F.col("__a")).alias("size"), "__a", "__row")).alias("m"))
    found = best.select(F.col(ip).alias("__ip"), *[F.col(f"m.__row.{c}").alias(c) for c in own])
    return addresses.join(found, addresses[ip] == found["__ip"], "left").drop("__ip")


def geolocated(hosts: DataFrame, names: DataFrame, ranges: DataFrame, hint: Column) -> DataFrame:
    """hostname, ip, country, region, city, lat, lon and error of every host: by its address (``names``: hostname, ip), else by what its name says
    (``hint`` gives country and region of a hostname, null where it says nothing). ``error`` tells what failed: dns_failed, dns_failed_name_hint, lookup_failed, or null."""
    at = located(hosts.select("hostname").distinct().join(names.groupBy("hostname").agg(F.min("ip").alias("ip")), "hostname", "left"), ranges)
    rows = at.withColumn("__h", hint)
    failed = F.when(F.col("ip").isNull(), F.when(F.col("__h.country").isNotNull(), "dns_failed_name_hint").otherwise("dns_failed")).when(F.col("country").isNull(), "lookup_failed")
    pick = lambda c: F.when(F.col("country").isNotNull(), F.col(c)).otherwise(F.col(f"__h.{c}")).alias(c)
    return rows.select("hostname", "ip", pick("country"), pick("region"), "city", "lat", "lon", failed.alias("error"))
