import hashlib
import re
import time

from arenaflow.llm import pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def keeps(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "", re.ASCII) if keeps(kind, m[0])]
    return sorted(found)


TEXTS = [
    None, "", "a@b.c_x@c.org", "mail bosbt.42@mail8.example.com now", "a@b a@b@c.d.e", "x" * 3000 + "@", "..a@-.-.b",
    "42.144.35.254 999.1.1.1 1.2.3.4.5.6.7.8 000255.1.01.0 256.1.1.1", "4041894974608795 4041 8949-7460 8795 1234567890123456 00000000000000",
    "+1 (743) 555-3824 +1-- +49 30 901820 +123", "é😀 4041894974608795, +1 (523) 555-1055 ü", "call +14041894974608795 1.1.1.1",
    "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433 xGB82WEST12345698765432", "SSN 123-45-6789", "the number 123-45-6789",
    "9" * 2000, "1.1.1.1" * 50, "a.b-c@d.e-f." * 200,
]


def test_base_spans_equal_plain_regular_expressions(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.summary(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        line = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in want)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (t, line, rows[i].spans)
        for kind, _ in BASE:
            assert rows[i][f"n_{kind}"] == sum(k == kind for _, _, k, _ in want)
        assert [x for x in rows[i].spans.split(",") if x and x.split(":")[0] in dict(BASE)] == [x for x in line.split(",") if x]


def test_method_adds_checked_and_contextual_kinds(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = {t: r.spans for t, r in zip(TEXTS, sorted(pii.summary(docs).collect(), key=lambda r: r.doc_id))}
    assert "iban:0:27" in rows[TEXTS[12]] and rows[TEXTS[12]].count("iban") == 1
    assert rows["SSN 123-45-6789"] == "ssn:4:15" and rows["the number 123-45-6789"] == ""


def test_iban_before_other_words(spark):
    texts = ["DE89 3704 0044 0532 0130 00 Please", "pay BE68 5390 0754 7034 Now 12", "DE89370400440532013000 A1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.summary(docs).collect()}
    assert got == {0: ["iban:0:27"], 1: ["iban:4:23"], 2: ["iban:0:22"]}


def iban(country, account):
    """A valid code of an account number, in groups of four."""
    turned = "".join(str(int(c, 36)) for c in account + country + "00")
    code = f"{country}{98 - int(turned) % 97:02d}{account}"
    return " ".join(code[i : i + 4] for i in range(0, len(code), 4))


def test_iban_before_capitals_and_numbers(spark):
    """Codes whose groups are full must not swallow the next word or number."""
    given = ["AT61 1904 3002 3457 3201 BANK of", "ES91 2100 0418 4502 0005 1332 2024 paid"]
    given += [f"{iban(c, a)} {after}" for c, a in (("BE", "539007547034"), ("SE", "50000000058398257466"), ("PL", "109010140000071219812874"), ("NO", "86011117947"), ("MT", "MALT011000012345MTLCAST001S"))
              for after in ("BANK", "2024", "ACME 2024", "12")]
    docs = spark.createDataFrame(list(enumerate(f"IBAN {t}" for t in given)), "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.summary(docs).collect()}
    size = {"AT": 24, "ES": 29, "BE": 19, "SE": 29, "PL": 34, "NO": 18, "MT": 38}
    assert got == {i: [f"iban:5:{5 + size[t[:2]]}"] for i, t in enumerate(given)}
    wrong = spark.createDataFrame([(1, "IBAN AT61 1904 3002 3457 3202 BANK"), (2, "XX61 1904 3002 3457 3201")], "doc_id long, text string")
    assert not any("iban" in r.spans for r in pii.summary(wrong).collect())


def test_redact_beside_a_column_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "kept", 3)], "doc_id long, text string, spans string, pieces int")
    assert tuple(pii.redact(docs).first()) == (1, "mail [EMAIL]", "kept", 3)


def test_cost_grows_with_the_number_of_spans(spark):
    """Sixteen thousand spans in one text, with astral characters between them; a quadratic way takes minutes."""
    parts = ["é😀 mail a.b@c.org, host 10.0.0.7 é", "123-45-6789 ssn, 4041894974608795 😀", "call +49 30 901820 now 1.2.3"]
    text = " ".join(parts[i % 3] for i in range(12_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    row = pii.summary(docs).first()
    want = brute(text)
    line = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in want)
    assert len(want) >= 16_000 and row.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and row.spans.count("ssn") == 4000
    clean = pii.redact(docs).first().text
    assert "@" not in clean and clean.count("[EMAIL]") == 4000 and clean.endswith("call [PHONE] now 1.2.3")
    assert time.time() - begin < 90


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org, é 1.2.3.4!", 7), (2, None, 7), (3, "clean", 7), (4, "call +378282246310005 x", 7)], "doc_id long, text string, extra int")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "mail [EMAIL], é [IP]!" and got[2].text is None and got[3].text == "clean" and got[1].extra == 7
    assert got[4].text == "call [PHONE] x"  # the card inside it is covered
    assert pii.redact(docs.filter("false")).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.summary(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
