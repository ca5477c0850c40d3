"""Fill-in-the-middle against plain slicing, byte automata against one byte after the other."""

import hashlib
import random

import pytest

from arenaflow.llm import fill_middle as fm


def plain_run(data, state):
    units, marked = 0, False
    for b in data:
        state, done, mark = fm.step(state, b)
        units, marked = units + done, marked or bool(mark)
    return state, units, marked


def test_stretches_equal_single_steps_from_every_state():
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"<PSM>ab\xc3\xa9\xe2\x82\xac\xf0\x9f\x98\x80") for _ in range(rng.choice([0, 1, 2, 5, 255, 256, 257, 900])))
        assert [fm.run(fm.stretches(data), s)[:3] for s in range(fm.STATES)] == [plain_run(data, s) for s in range(fm.STATES)]


def test_composition_is_associative():
    known = fm.monoid()[0]
    rng = random.Random(4)
    for a, b, c in ([rng.choice(known) for _ in range(3)] for _ in range(500)):
        assert fm.then(fm.then(a, b)[0], c)[0] == fm.then(a, fm.then(b, c)[0])[0]


def expected(i, text):
    text, n = text or "", len(text or "")
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def texts():
    rng = random.Random(5)
    alphabet = list("ab <PSM>é€😀\ń‍")
    small = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    # marks, units and cuts on the bounds of chunks of several bytes
    giant = ["x" * (fm.CHUNK - k) + m + "é€😀" * 30_000 for k in range(4) for m in ("<P>", "<P", "€", "😀", "")]
    return small + giant + ["", None, "<", "<P", "<P>", "a" * fm.CHUNK, "a" * (fm.CHUNK + 1), "€" * 100_000]


def test_equals_plain_slicing(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a<b" * 9), (None, None), (7, "again"), (7, "again"), (7, "other")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, n string, form string, first int")
    got = sorted(map(str, (tuple(r) for r in fm.summary(docs).collect())))
    assert got == sorted(str((i, *expected(i, t))) for i, t in rows)
    assert fm.summary(docs.filter("false")).count() == 0


def test_both_ways_of_a_text_agree(spark, monkeypatch):
    """Chunks of 16 bytes send nearly every text through composition and selection."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices(list("ab <PSM>é€😀"), k=rng.randint(0, 200)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, fm.cut_documents(docs).collect()))
    monkeypatch.setattr(fm, "CHUNK", 16)
    assert sorted(map(tuple, fm.cut_documents(docs).collect())) == want


@pytest.mark.parametrize("form,output", [("psm", "<P>a<<S>c<M>b<"), ("spm", "<S>c<P>a<<M>b<"), ("plain", "a<b<c")])
def test_restored(spark, form, output):
    df = spark.createDataFrame([(output, form)], "output string, form string")
    assert df.select(fm.restored("output", "form")).first()[0] == "a<b<c"
