"""Personal data in texts, with DataFrame functions only.

For every kind a regular expression proposes spans. ``split`` by the same pattern gives the gaps between the matches, so running
sums of gap and match lengths are the offsets in code points. Checksums (Luhn, mod-97) and limits confirm or drop a match, and
words of the same kind within a few characters raise its score. Kinds of ``BASE`` keep every confirmed match whatever its score;
the others need ``least_score``. Everything stays in one projection over each row: no shuffle, no Python.

Cost grows with the text and with the number of its spans, not with their product: a text that lacks what every confirmed match of a kind
must hold isn't searched for that kind, lists are gathered in short parts (``gathered``), and what stands around a span is read from
the text cut into PIECE characters.

Cases: a null text counts as empty and gives no spans; spans of different kinds may overlap; equal starts are ordered by kind as
listed; repeated rows each give a row; ``redact`` leaves null texts null and passes all other columns on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import text_or_empty


@dataclass(frozen=True)
class Kind:
    """``needs``: a character of every match (0: any digit); ``words``: lower-case context words; ``score``: of a confirmed match without
    them; ``bounded``: no letter or digit may touch it."""

    name: str
    pattern: str
    needs: str
    score: float
    words: tuple[str, ...]
    base: bool = True
    bounded: bool = False


#: Length of an account code by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Account codes of each country's length, in one piece or in groups of four, so that a word or number behind one is no part of it."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        spaced = rf"(?:\x20[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20[A-Z0-9]{{{rest}}}" if rest else "")
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})")
    return "(?:" + "|".join(forms) + ")"


IBAN = iban_pattern()
# The possessive quantifiers and the look-behind change no match: they keep long runs of one class from being tried again at each place.
#: Kinds in order, with their patterns.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, ("mail", "contact", "write")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "0", 0.5, ("address", "host", "server", "login")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "0", 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", IBAN, "0", 0.7, ("iban", "account", "bank"), base=False, bounded=True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "0", 0.2, ("ssn", "social security"), base=False, bounded=True),
)
#: Added to the score if a context word stands within CONTEXT characters before or after.
BOOST, CONTEXT = 0.3, 40
#: Characters of a text in one piece; items in one part of a list that is gathered.
PIECE, PART = 256, 64
SPAN = "struct<start:int,ord:int,kind:string,end:int,score:double>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (upper case, no blanks) has the remainder 1 after its first four characters go to the end."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c < "A", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """What a match must pass besides its pattern."""
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits(match)).between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def gathered(items: Column, element: str, step) -> Column:
    """The list of what ``step(pos, item)`` adds: it gets the place reached so far (0 at first) and gives the next place and a list. Lists are
    gathered in parts of PART items, so that no long list is copied for each item."""
    empty = F.array().cast(f"array<{element}>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int")), lambda i: F.slice(items, i * PART + 1, F.lit(PART)))

    def one(acc: Column, x: Column) -> Column:
        pos, more = step(acc["pos"], x)
        return F.struct(pos.alias("pos"), F.concat(acc["out"], more).alias("out"))

    def whole(acc: Column, part: Column) -> Column:
        return F.aggregate(
            part, F.struct(acc["pos"].alias("pos"), empty.alias("out")), one,
            lambda a: F.struct(a["pos"].alias("pos"), F.concat(acc["out"], F.array(a["out"])).alias("out")),
        )

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{element}>>").alias("out"))
    return F.aggregate(parts, start, whole, lambda acc: F.flatten(acc["out"]))


def cut(text: Column) -> Column:
    """A text in pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def stretch(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` (exclusive; past the end there are none)."""
    first = F.floor(start / PIECE).cast("int")
    many = F.floor((end - 1) / PIECE).cast("int") - first + 1
    # slice copies the whole list first, so it is left to stretches as long as that is worth
    two = F.concat(*[F.coalesce(F.get(pieces, first + i), F.lit("")) for i in (0, 1)])
    held = F.when(many <= 2, two).otherwise(F.array_join(F.slice(pieces, first + 1, F.greatest(many, F.lit(0))), ""))
    return F.substring(held, start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def found(text: Column, matches: Column, pieces: Column, kind: Kind, order: int) -> Column:
    """array<SPAN> of one kind, whose ``matches`` in the text are given."""
    steps = F.zip_with(
        F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches)), matches,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )
    none = F.array().cast(f"array<{SPAN}>")

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        start = pos + s["gap"]
        end = start + F.length(s["match"])
        left = F.greatest(start - CONTEXT, F.lit(0))
        ok = confirmed(kind.name, s["match"])
        if kind.bounded:
            around = F.concat(stretch(pieces, F.greatest(start - 1, F.lit(0)), start), stretch(pieces, end, end + 1))
            ok = ok & ~around.rlike("[A-Za-z0-9]")
        near = F.lower(F.concat(stretch(pieces, left, start), F.lit("\n"), stretch(pieces, end, end + CONTEXT)))
        boost = F.when(near.rlike("|".join(kind.words)), BOOST).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), end.alias("end"), (F.lit(kind.score) + boost).alias("score"))
        return end, F.when(ok, F.array(span)).otherwise(none)

    return F.when(F.size(matches) > 0, gathered(steps, SPAN, step)).otherwise(none)


def find_spans(docs: DataFrame, least_score: float = 0.5, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with an array of {start, ord, kind, end, score} by start, then kind; offsets in code points, end exclusive."""
    text = text_or_empty(text_col)
    names = [f"__{out_col}_{k.name}" for k in KINDS]
    nothing = F.array().cast("array<string>")
    pieces, digit = f"__{out_col}_pieces", f"__{out_col}_digit"

    def proposed(kind: Kind) -> Column:
        may = F.col(digit) if kind.needs == "0" else text.contains(kind.needs)
        return F.when(may, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(nothing)

    kept = docs.withColumn(digit, text.rlike("[0-9]")).withColumns({n: proposed(k) for k, n in zip(KINDS, names)})
    kept = kept.withColumn(pieces, F.when(F.greatest(*[F.size(n) for n in names]) > 0, cut(text)).otherwise(nothing))
    kept = kept.withColumns({n: found(text, F.col(n), F.col(pieces), k, i) for i, (k, n) in enumerate(zip(KINDS, names))})
    base = [F.col(n) for k, n in zip(KINDS, names) if k.base]
    more = [F.filter(F.col(n), lambda s: s["score"] >= least_score) for k, n in zip(KINDS, names) if not k.base]
    return kept.withColumn(out_col, F.array_sort(F.concat(*base, *more))).drop(*names, pieces, digit)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter(F.col("spans"), lambda s: s["kind"] == kind))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of every row: counts of base kinds, the hash of the base spans and all spans."""
    base = [k.name for k in KINDS if k.base]
    s = find_spans(docs.select(F.col(id_col), F.col(text_col)), text_col=text_col)
    of_base = F.filter(F.col("spans"), lambda x: x["ord"] < len(base))
    return s.select(
        id_col,
        *[count_of(n).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(listed(of_base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become the first one's mark."""
    spans = find_spans(docs, text_col=text_col, out_col="__spans")
    text = F.col(text_col)

    pieces = F.col("__pieces")

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        fresh = F.array(stretch(pieces, pos, s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, fresh).otherwise(F.array().cast("array<string>"))

    # a last mark at the end brings the rest of the text
    end = F.struct(F.length(text).alias("start"), F.lit(0).alias("ord"), F.lit("").alias("kind"), F.length(text).alias("end"), F.lit(0.0).alias("score"))
    marks = F.concat(F.col("__spans"), F.array(end.cast(SPAN)))
    clean = F.regexp_replace(F.array_join(gathered(marks, "string", step), ""), r"\[\]$", "")
    cutted = spans.withColumn("__pieces", F.when(F.size("__spans") > 0, cut(text)).otherwise(F.array().cast("array<string>")))
    return cutted.withColumn(text_col, F.when(F.size("__spans") > 0, clean).otherwise(text)).drop("__spans", "__pieces")
