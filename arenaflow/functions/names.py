"""Name, host and URL normalisation as Column chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arenaflow.functions.exprs import c

#: Regional codes that don't belong to a name when a dot follows them.
PREFIXES = (
    "au", "na", "eu", "sa", "uk", "us", "ru", "de", "fr", "se", "fi", "no", "dk", "nl", "it", "es", "br", "jp", "kr", "cn", "pl", "cz", "hu", "ie", "be", "ca", "mx",
    "ar", "cl", "pt", "gr", "tr", "at", "ch", "il", "nz", "za",
)
#: What decorates the ends of a name, as a character class, and the brackets that may stay in pairs.
DECORATION = r"\s\[\](){}<>|\\/*+\-_=~`!@#$%^&.,;:?\"'"
BRACKETS = (r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"), ("<", ">")
#: Ordered host rules, first match wins.
HOST_REGIONS = ((r"(^|\.)(de|fr|es|uk|eu)\b", "EU"), (r"\.com$", "NA"), (r"\.net$", "SA"), (r"\.org$", "OC"))


def squeezed(x) -> Column:
    """Lower case, only letters and digits."""
    return F.regexp_replace(F.lower(c(x)), "[^a-z0-9]", "")


def plain_letters(x) -> Column:
    """High-bit letters and digits of the game's character set and its coloured digits as their plain ones; all else that isn't printable goes."""
    digits = "".join(chr(first + i) for first in (0x12, 0x92) for i in range(10))
    high = "".join(chr(i) for i in range(0xA0, 0xFF))
    low = "".join(chr(i - 128) for i in range(0xA0, 0xFF))
    return F.regexp_replace(F.translate(c(x), high + digits, low + "0123456789" * 2), r"[^\x20-\x7e]", "")


def normalised(x) -> Column:
    """Canonical form of a raw or stored name: plain letters, lower case, no decoration at the ends, single blanks, no regional prefix."""
    s = F.lower(plain_letters(unescaped(x)))
    s = F.regexp_replace(s, f"^[{DECORATION}]+|[{DECORATION}]+$", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.trim(F.regexp_replace(s, rf"^(?:{'|'.join(PREFIXES)})\.(.+)$", "$1"))


def longest(*parts: Column) -> Column:
    return F.array_max(F.array(*[F.struct(F.length(p).alias("n"), p.alias("part")) for p in parts]))["part"]


def trimmed(x) -> Column:
    """Without the decoration at the ends, but a bracket stays where its partner stands inside."""
    s = longest(*[F.regexp_extract(c(x), p, 0) for p in (rf"^(?s).*[^{DECORATION}]", *(f"^(?s).*{a}.*{b}" for a, b in BRACKETS))])
    return longest(*[F.regexp_extract(s, p, 0) for p in (rf"(?s)[^{DECORATION}].*$", *(f"(?s){a}.*{b}.*$" for a, b in BRACKETS))])


def for_display(x) -> Column:
    """A name to show: plain letters, case and inner punctuation kept, single blanks, ends trimmed with paired brackets left."""
    return F.trim(trimmed(F.trim(F.regexp_replace(plain_letters(unescaped(x)), r"\s+", " "))))


def escaped(x) -> Column:
    r"""The stored form of a raw name: every character of the game's set that isn't printable becomes a marked plain one, any other ``\xNN``."""

    def one(ch: Column) -> Column:
        o, slash = F.ascii(ch), F.lit("\\")
        plain = F.when(o == 0x5C, F.lit("\\\\")).otherwise(ch)
        high = F.when(o == 0xDC, F.lit("\\5\\\\")).otherwise(F.concat(slash, F.lit("5"), F.chr(o - 128)))
        return (
            F.when(o.isin(0x10, 0x11), F.concat(slash, F.lit("1"), F.when(o == 0x10, "[").otherwise("]")))
            .when(o.between(0x12, 0x1B), F.concat(slash, F.lit("2"), F.chr(o + 30))).when(o.between(0x20, 0x7E), plain)
            .when(o.isin(0x90, 0x91), F.concat(slash, F.lit("3"), F.when(o == 0x90, "[").otherwise("]")))
            .when(o.between(0x92, 0x9B), F.concat(slash, F.lit("4"), F.chr(o - 98))).when(o.between(0xA0, 0xFE), high)
            .otherwise(F.concat(slash, F.lit("x"), F.when(o < 16, "0").otherwise(""), F.lower(F.hex(o))))
        )

    letters = F.filter(F.split(c(x), ""), lambda ch: ch != "")
    return F.array_join(F.transform(letters, one), "")


def unescaped(x) -> Column:
    r"""Plain text of a stored name: a backslash and a digit mark a character of the game's set, ``\xNN`` an unknown byte. Marked brackets
    and unknown bytes go, marked digits and letters stay, a doubled backslash is one."""
    mark = "\ue000"  # stands for a literal backslash meanwhile
    s = F.regexp_replace(c(x), r"(?:\\5)?\\\\", mark)
    s = F.regexp_replace(s, r"\\x[0-9A-Fa-f]{2}|\\[13].?", "")
    s = F.regexp_replace(s, r"\\[24](?:([0-9])|.?)", "$1")
    return F.replace(F.regexp_replace(s, r"\\5(.?)", "$1"), F.lit(mark), F.lit("\\"))


def host(url) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[^:]+://([^/?#:]*)", 1))


def host_root(hostname) -> Column:
    return F.split_part(c(hostname), F.lit(":"), F.lit(1))


def clean_host(hostname) -> Column:
    """Without what precedes an @, the first word, lower case."""
    return F.element_at(F.split(F.trim(F.lower(F.element_at(F.split(c(hostname), "@"), -1))), r"\s+"), 1)


def port(hostname) -> Column:
    return F.regexp_extract(c(hostname), r"^(.*?):(\d+)(?:\s|$)", 2).try_cast("int")


def basename(url) -> Column:
    return F.substring_index(c(url), "/", -1)


def first_rule(x, rules=HOST_REGIONS) -> Column:
    """The value of the first pattern that matches, else null."""
    return F.coalesce(*[F.when(c(x).rlike(p), v) for p, v in rules])


def info_string(x) -> Column:
    r"""A map from ``\key\value\key\value`` (text that doesn't begin with a backslash gives an empty map)."""
    parts = F.filter(F.split(F.substring(c(x), 2, 1 << 20), r"\\"), lambda p: p.isNotNull())
    pairs = F.transform(F.sequence(F.lit(0), (F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(parts[i * 2], parts[i * 2 + 1]))
    return F.when(c(x).startswith("\\") & (F.size(parts) >= 2), F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>"))
