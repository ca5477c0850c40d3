"""Fill-in-the-middle examples cut by a parallel automaton scan.

A text is read as UTF-8 bytes by one automaton that counts its units (code points) and notices the marks ``<P>``, ``<S>`` and ``<M>``. Its
states are the code point's bytes still to come, or how much of a mark has been seen. What a stretch of bytes does is a function of the state
in which it is entered: the state that it leaves, the units that it completes and whether a mark ends in it. Such functions compose
associatively, so stretches are scanned apart and in any order: neighbouring bytes are composed pairwise, then pairs, and so on, for a whole batch at
once. The functions that can occur are few (the automaton's transition monoid), so a stretch is one small number and its count.

Texts of more than CHUNK bytes are dealt to tasks in chunks of CHUNK bytes, which may begin inside a code point or a mark. Each chunk emits
its exit state, count and marks for every entry state; composing them in order gives the entry state and the units before each
chunk. Only the chunks into which a cut falls are then read again, from their entry state, to find the cut's byte. A text of at
most 2 GB, Spark's limit, has at most 32768 chunks of some 100 bytes of functions to compose. Shorter texts are one chunk, found by the same steps
inside their task, and move nowhere. Which way a text goes changes no result.

Draws: h1 to h4 are the first four groups of 8 hex digits of sha256("1:" + id). The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) units, the middle after the larger. The form is plain for empty texts, texts with a mark and where h3 % 100 >= 90; else
spm where h4 % 100 < 20, else psm.

Cases: null texts are empty; a null id draws as "1:"; repeated rows each give the same row; an empty table gives no row; other
columns are ignored whatever their names; ``text`` may hold any code points, those that no longer form characters once cut included,
as cuts fall between code points.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenaflow.llm.common import text_or_empty

SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
#: Bytes of a chunk, and of the blocks inside one (a power of two).
CHUNK, BLOCK = 65_536, 256
#: States: 0 between units, 1 after "<", 2 after "<" and a letter of a mark, 3 to 5 with one to three bytes of a unit to come.
STATES, LETTERS = 6, b"PSM"
FUNCTION = "ends array<int>, counts array<long>, marks array<boolean>"
PLACED = "n long, marked boolean, first long, second long, first_byte long, second_byte long"
COMPOSED = "n long, marked boolean, chunks array<struct<no: int, entry: int, before: long, after: long>>"


def step(state: int, byte: int) -> tuple[int, int, int]:
    """The next state, and whether a unit and a mark end with the byte. A byte that can't follow begins anew, so that every byte has a step."""
    if byte & 0xC0 == 0x80:
        return (0, 0, 0) if state < 3 else (0, 1, 0) if state == 3 else (state - 1, 0, 0)
    if byte >= 0xC0:
        return (3 if byte < 0xE0 else 4 if byte < 0xF0 else 5), 0, 0
    if byte == ord("<"):
        return 1, 1, 0
    if state == 1 and byte in LETTERS:
        return 2, 1, 0
    return 0, 1, int(state == 2 and byte == ord(">"))


def then(left: tuple, right: tuple) -> tuple[tuple, int]:
    """The function of two stretches in a row, and the units that ``right`` adds where ``left`` is entered between units. A function is, for
    each entry state, the exit state, the units beyond those for entry state 0, and whether a mark ends."""
    (end, more, mark), (end2, more2, mark2) = left, right
    added = more2[end[0]]
    return (
        tuple(end2[e] for e in end),
        tuple(m + more2[e] - added for m, e in zip(more, end)),
        tuple(m or mark2[e] for m, e in zip(mark, end)),
    ), added


@cache
def monoid() -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions of stretches (the first is that of an empty one), the function and the units (from entry state 0) of each byte value, and for two
    functions in a row the number of the composed one and the units that the second adds to its own."""
    identity = (tuple(range(STATES)), (0,) * STATES, (0,) * STATES)
    singles, units = [], []
    for b in range(256):
        ends, counts, marks = zip(*(step(s, b) for s in range(STATES)))
        singles.append((ends, tuple(c - counts[0] for c in counts), marks))
        units.append(counts[0])
    number, known = {identity: 0}, [identity]
    at = 0
    while at < len(known):
        for single in dict.fromkeys(singles):
            f, _ = then(known[at], single)
            if f not in number:
                number[f] = len(known)
                known.append(f)
        at += 1
    pairs = [[then(a, b) for b in known] for a in known]
    return (
        known, np.array([number[f] for f in singles], np.uint16), np.array(units, np.int32),
        np.array([[number[f] for f, _ in row] for row in pairs], np.uint16), np.array([[more for _, more in row] for row in pairs], np.int32),
    )


def blocks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Function and units of every BLOCK bytes: neighbours are composed until a block is one function."""
    known, of_byte, units, composed, added = monoid()
    raw = np.frombuffer(data, np.uint8)
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    f, n = np.zeros(size, np.uint16), np.zeros(size, np.int32)
    f[: len(raw)], n[: len(raw)] = of_byte[raw], units[raw]
    for _ in range(BLOCK.bit_length() - 1):
        pair = f[0::2].astype(np.int32) * len(known) + f[1::2]
        n = n[0::2] + n[1::2] + added.ravel()[pair]
        f = composed.ravel()[pair]
    return f, n


def run(functions: list[tuple[tuple, int]], state: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Exit state, units, whether a mark ended, and the entry state and the units before each stretch. A stretch is its function and units."""
    count, marked, entered = 0, False, []
    for (ends, more, marks), n in functions:
        entered.append((state, count))
        count += n + more[state]
        marked = marked or bool(marks[state])
        state = ends[state]
    return state, count, marked, entered


def stretches(data: bytes) -> list[tuple[tuple, int]]:
    known = monoid()[0]
    f, n = blocks_of(data)
    return [(known[i], c) for i, c in zip(f.tolist(), n.tolist())]


def byte_of(data: bytes, entered: list[tuple[int, int]], unit: int) -> int:
    """The byte after which ``unit`` units are complete; ``entered`` are the states and units in which the blocks of ``data`` begin."""
    if unit <= entered[0][1]:
        return 0
    at = bisect_left(entered, unit, key=lambda e: e[1]) - 1
    state, count = entered[at]
    for i in range(at * BLOCK, len(data)):
        state, done, _ = step(state, data[i])
        count += done
        if count == unit:
            return i + 1
    return len(data)


def function_of(chunks: pd.Series) -> pd.DataFrame:
    """What each chunk does, for every entry state."""
    out = []
    for data in chunks:
        parts = stretches(bytes(data))
        ran = [run(parts, s)[:3] for s in range(STATES)]
        out.append(tuple(list(x) for x in zip(*ran)))
    return pd.DataFrame(out, columns=["ends", "counts", "marks"])


def composed_of(functions: pd.Series) -> pd.DataFrame:
    """Units and marks of the texts whose chunks' functions (in order) are given, and the entry state and the units before and after every chunk."""
    out = []
    for chunks in functions:
        state, count, marked, placed = 0, 0, False, []
        for c in chunks:
            after = count + int(c["counts"][state])
            placed.append({"no": c["no"], "entry": state, "before": count, "after": after})
            marked, state, count = marked or bool(c["marks"][state]), int(c["ends"][state]), after
        out.append((count, marked, placed))
    return pd.DataFrame(out, columns=["n", "marked", "chunks"])


def placed_in(chunk: pd.Series, entry: pd.Series, units: pd.Series) -> pd.Series:
    """The byte of each chunk, entered in state ``entry``, after which so many of its units are complete."""
    return pd.Series([byte_of(d := bytes(data), run(stretches(d), s)[3], u) for data, s, u in zip(chunk, entry, units)], dtype="int64")


def placed(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Units, marks and cuts of whole texts of one chunk each."""
    out = []
    for text, a, b in zip(texts, h1, h2):
        data = text.encode("utf-8", "surrogatepass")
        _, n, marked, entered = run(stretches(data), 0)
        first, second = sorted((int(a) % (n + 1), int(b) % (n + 1)))
        out.append((n, marked, first, second, byte_of(data, entered, first), byte_of(data, entered, second)))
    return pd.DataFrame(out, columns=["n", "marked", "first", "second", "first_byte", "second_byte"])


def draw(i: int) -> Column:
    """The i-th group (from 0) of the digest as a number."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def giant_cuts(giants: DataFrame) -> DataFrame:
    """key and the columns of PLACED for texts of several chunks; ``giants`` has key, bytes, h1 and h2, one row a key."""
    slices = F.expr(f"transform(sequence(0, (octet_length(bytes) - 1) div {CHUNK}), i -> substring(bytes, cast(i * {CHUNK} + 1 as int), {CHUNK}))")
    chunks = giants.select("key", F.posexplode(slices).alias("no", "chunk")).repartition("key", "no")
    function = F.pandas_udf(function_of, FUNCTION)("chunk")
    functions = chunks.select("key", "no", function.alias("f")).select("key", F.struct("no", "f.ends", "f.counts", "f.marks").alias("f"))
    whole = functions.groupBy("key").agg(F.sort_array(F.collect_list("f")).alias("f"))  # at most 2 GB / CHUNK small entries
    whole = whole.select("key", F.pandas_udf(composed_of, COMPOSED)("f").alias("c")).select("key", "c.*")
    whole = whole.join(giants.select("key", "h1", "h2"), "key")
    low, high = F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))
    cuts = whole.select("key", "n", "marked", "chunks", low.alias("first"), high.alias("second"))
    each = cuts.select("key", "chunks", F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("cut")) for c in ("first", "second")])).alias("w"))
    hit = F.get(F.filter("chunks", lambda c: (c["before"] < F.col("w.cut")) & (F.col("w.cut") <= c["after"])), 0)
    hit = each.select("key", "w.*", hit.alias("hit")).filter("hit is not null").select("key", "which", "cut", "hit.*")
    found = hit.join(chunks, ["key", "no"]).select(
        "key", "which", (F.col("no").cast("long") * CHUNK + F.pandas_udf(placed_in, "long")("chunk", "entry", F.col("cut") - F.col("before"))).alias("byte"))
    at = found.groupBy("key").agg(*[F.max(F.when(F.col("which") == c, F.col("byte"))).alias(f"{c}_byte") for c in ("first", "second")])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("first_byte", "second_byte")]  # a cut before the first unit
    return cuts.join(at, "key", "left").select("key", "n", "marked", "first", "second", *zero)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", "text", *[draw(i).alias(f"h{i + 1}") for i in range(4)])
    fields = [f.split()[0] for f in PLACED.split(", ")]
    few = base.filter(F.octet_length("text") <= CHUNK).select("*", F.pandas_udf(placed, PLACED)("text", "h1", "h2").alias("p")).select("id", "text", "h3", "h4", *[f"p.{f}" for f in fields])
    many = base.filter(F.octet_length("text") > CHUNK).withColumn("key", F.sha2(F.concat_ws(":", "h1", "h2", F.sha2("text", 256)), 256))
    cuts = giant_cuts(many.select("key", F.col("text").cast("binary").alias("bytes"), "h1", "h2").dropDuplicates(["key"]))
    rows = few.unionByName(many.join(cuts, "key").select("id", "text", "h3", "h4", *fields))
    plain = (F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).withColumn("bytes", F.col("text").cast("binary"))
    parts = {
        "P": F.expr("substring(bytes, 1, cast(first_byte as int))"), "S": F.expr("substring(bytes, cast(second_byte + 1 as int))"),
        "M": F.expr("substring(bytes, cast(first_byte + 1 as int), cast(second_byte - first_byte as int))"),
    }
    joined = {order: F.concat(*[x for p in order for x in (F.lit(f"<{p}>").cast("binary"), parts[p])]) for order in ("PSM", "SPM")}
    output = F.when(F.col("form") == "psm", joined["PSM"]).when(F.col("form") == "spm", joined["SPM"]).otherwise(F.col("bytes")).cast("string")
    size = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(
        F.col("id").alias(id_col), "n", "form", size(F.col("first")).alias("prefix_chars"), size(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text of an output. A text with a mark is plain, so that each mark stands once in the other forms."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    mark = {m: F.lit(f"<{m}>") for m in "PSM"}
    piece = lambda text, m, i: F.split_part(text, mark[m], F.lit(i))
    middle = piece(output, "M", 2)
    psm = F.concat(piece(piece(output, "S", 1), "P", 2), middle, piece(piece(output, "S", 2), "M", 1))
    spm = F.concat(piece(piece(output, "P", 2), "M", 1), middle, piece(piece(output, "P", 1), "S", 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cut_documents`` with digests of the output and of the text that is rebuilt from it instead of the output."""
    made = cut_documents(docs, id_col, text_col)
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
