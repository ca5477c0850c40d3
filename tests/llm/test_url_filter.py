from arenaflow.llm import url_filter as uf

RULES = (("allow", "good.example", "/"), ("block", "bad.example", "/"))


def page(i, url, *links):
    return (i, url, "".join(f'<a href="{x}">' for x in links), "x")


PAGES = [
    page(1, "http://good.example/a", "http://friend.example/"), page(2, "http://friend.example/", "http://friend.example/b"),
    page(3, "https://BAD.example/x?u=://q"), page(4, "http://farm.example/p", "http://bad.example/", "http://bad.example/2"),
    page(5, "http://farm2.example/p", "http://sub.bad.example/"), page(6, "http://sub.bad.example/z"), (7, None, None, "x"), (8, "nothing", "<a>", "x"),
    page(9, "http://calm.example/"), page(4, "http://farm.example/p", "http://bad.example/", "http://bad.example/2"), page(10, "http://empty.example"),
]


def scores(edges, seeds, rounds=10, d=0.85):
    """Plain personalised PageRank over weighted edges."""
    out = {}
    for a, b, n in edges:
        out[a] = out.get(a, 0) + n
    r = dict(seeds)
    for _ in range(rounds):
        new = {}
        for a, b, n in edges:
            if a in r:
                new[b] = new.get(b, 0) + d * r[a] * n / out[a]
        lost = 1 - sum(new.values())
        r = {h: new.get(h, 0) + lost * seeds.get(h, 0) for h in new.keys() | seeds.keys()}
    return r


def test_propagation_equals_plain_page_rank(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, host string")
    judged = uf.judged_by_rule(pages.select("page_id", "url"), RULES)
    edges = uf.host_edges(pages)
    e = [tuple(r) for r in edges.collect()]
    assert sorted(e) == [("farm.example", "bad.example", 4), ("farm2.example", "sub.bad.example", 1), ("good.example", "friend.example", 1)]
    got = {r.host: r for r in uf.host_scores(judged.select("host", "by_rule"), edges).collect()}
    assert abs(sum(r.trust for r in got.values()) - 1) < 1e-9 and abs(sum(r.distrust for r in got.values()) - 1) < 1e-9
    bad = {"bad.example": 0.5, "sub.bad.example": 0.5}
    for host, s in scores([(b, a, n) for a, b, n in e], bad).items():
        assert abs(got[host].distrust - s) < 1e-12
    for host, s in scores(e, {"good.example": 1.0}).items():
        assert abs(got[host].trust - s) < 1e-12


def test_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in uf.judge(pages, RULES, least=0.3).collect()}
    blocked = {3, 4, 5, 6}
    assert {i: r.verdict for i, r in got.items()} == {i: "block" if i in blocked else "allow" for i in range(1, 11)}
    assert (got[3].host, got[3].path, got[3].rule, got[3].settled_by) == ("bad.example", "/x", "bad.example/", "rule")
    assert (got[7].host, got[7].path, got[7].rule) == ("", "", None) and got[10].rule is None and got[10].path == ""
    assert uf.judge(pages, RULES).count() == len(PAGES)
    assert uf.judge(pages.filter("false"), RULES).count() == 0


def test_longest_rule_wins(spark):
    urls = ["http://a.example.com/en/71", "http://a.example.com/en/1", "x://example.net/de/8", "x://b.net/de/8", "x://z.org/es/", "x://notcom/en/", "x://com/en/?"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.by_rule) for r in uf.judged_by_rule(pages).orderBy("page_id").collect()]
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, None), ("com/en/", "block")]
