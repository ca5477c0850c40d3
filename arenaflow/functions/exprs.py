"""Scalar macros. Each returns a Column; null inputs give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rating model's reporting side.
SIGMA_CAP, IDLE_GRACE_DAYS, IDLE_GROWTH = 500.0, 30, 0.5
MARGIN_CAP, MARGIN_SCALE = 70.0, 2575.0
TIER_SHARES = (0.95, 0.80, 0.50, 0.20)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_week(ts) -> Column:
    """IYYY-IW of a timestamp."""
    return F.format_string("%d-%02d", F.extract(F.lit("YEAROFWEEK"), c(ts)), F.weekofyear(c(ts)))


def day_of_week(ts) -> Column:
    """Sunday is 0."""
    return F.dayofweek(c(ts)) - 1


def half_open(ts, start, end) -> Column:
    """start <= ts < end, both as literals in UTC."""
    return (c(ts) >= F.lit(start).cast("timestamp_ntz")) & (c(ts) < F.lit(end).cast("timestamp_ntz"))


def relative_window(ts, now: str, days: int, offset: int = 0) -> Column:
    """[now - days - offset, now - offset); ``now`` is an argument so that results repeat."""
    at = F.lit(now).cast("timestamp_ntz")
    lo, hi = at - F.expr(f"interval {days + offset} days"), at - F.expr(f"interval {offset} days")
    return (c(ts) >= lo) & (c(ts) < hi)


def shortest_arc(a, b) -> Column:
    """Difference of two headings in degrees, in [-180, 180)."""
    return F.pmod(c(a) - c(b) + 180, F.lit(360.0)) - 180


def angle16(raw) -> Column:
    return c(raw) * 360.0 / 65536.0


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-c(x)))


def normal_cdf(x) -> Column:
    """By the rational approximation of erf, Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    z = F.abs(c(x)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(c(x) >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def estimated_ping(km) -> Column:
    return 20 + 0.025 * c(km)


def decayed_sigma(sigma, idle_days) -> Column:
    """Uncertainty that grows after a grace time without matches."""
    idle = F.greatest(F.lit(0.0), c(idle_days).cast("double") - IDLE_GRACE_DAYS)
    return F.sqrt(F.pow(c(sigma), 2) + F.pow(IDLE_GROWTH * idle, 2))


def expected_margin(mu_a, mu_b) -> Column:
    return MARGIN_CAP * F.tanh((c(mu_a) - c(mu_b)) / MARGIN_SCALE)


def tier(value, cutoffs: list) -> Column:
    """1 for the highest tier; ``cutoffs`` descend."""
    out = F.lit(len(cutoffs) + 1)
    for i, cut in reversed(list(enumerate(cutoffs))):
        out = F.when(c(value) >= cut, i + 1).otherwise(out)
    return F.when(c(value).isNotNull(), out)


def provisional(sigma, opponents) -> Column:
    return (c(sigma) > 150) | (c(opponents) < 10)


def rated(games, opponents) -> Column:
    return (c(games) >= 10) & (c(opponents) >= 4)


def shrunk_to_mean(x, n, mean, prior: float = 150.0) -> Column:
    return (c(n) * c(x) + prior * c(mean)) / (c(n) + prior)


def head_to_head_blend(p, rate, n, least: int = 10, prior: float = 8.0) -> Column:
    """Model probability blended with the record once there are enough meetings."""
    return F.when(c(n) >= least, (c(n) * c(rate) + prior * c(p)) / (c(n) + prior)).otherwise(c(p))


def small_sample(rate, n) -> Column:
    return F.greatest(F.lit(0.15), F.least(F.lit(0.85), 0.5 + c(n) / (c(n) + 4.0) * (c(rate) - 0.5)))


def money_line(p) -> Column:
    """American odds of a probability, to the nearest 5."""
    raw = F.when(c(p) >= 0.5, -100 * c(p) / (1 - c(p))).otherwise(100 * (1 - c(p)) / c(p))
    return (F.floor(raw / 5 + 0.5) * 5).cast("long")


def market_line(p) -> Column:
    """American odds with the house's margin on both sides (1.07 and 0.90), to the nearest 5; the probability is held within 0.15 and 0.85."""
    w = F.greatest(F.lit(0.15), F.least(F.lit(0.85), c(p)))
    raw = F.when(w >= 0.5, -100 * w / (1 - w) * 1.07).otherwise(100 * (1 - w) / w * 0.90)
    return (F.bround(raw / 5) * 5).cast("long")


def rounded(x, digits: int) -> Column:
    """Rounds up from the half and from what a sum in another order would make of it."""
    return F.round(c(x) + 1e-9, digits)


def expected_maps(p) -> Column:
    """Maps of a best of three in which each is won with probability p."""
    return 2 + 2 * c(p) * (1 - c(p))


def hash_id(key) -> Column:
    """A negative id from the first 15 hex digits of the key's SHA-256."""
    return -F.conv(F.substring(F.sha2(c(key), 256), 1, 15), 16, 10).cast("long")


def evening(ts) -> Column:
    """The day to which an evening belongs: what happens before six counts for the day before."""
    return F.to_date(c(ts) - F.expr("interval 6 hours"))


def content_hash(*fields) -> Column:
    """SHA-256 of the fields as JSON: changes when any of them does."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def band_score(x, low: float, high: float) -> Column:
    """0 to 99: full within [low, high], linear to 0 at twice the distance."""
    width = high - low
    off = F.greatest(F.lit(low) - c(x), c(x) - F.lit(high), F.lit(0.0))
    return F.round(99 * F.greatest(F.lit(0.0), 1 - off / width), 6)
