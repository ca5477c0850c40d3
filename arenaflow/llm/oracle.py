"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

from arenaflow.llm import pii, url_filter

OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), o AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Shingles by position; pairs of different sets by the shingles in common; components by everything that is reached from each.
OP11 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS sh FROM d
), k AS (SELECT *, md5(array_to_string(sh, chr(10))) AS digest FROM s),
u AS (SELECT digest, any_value(sh) AS sh, min(doc_id) AS low FROM k WHERE len(sh) > 0 GROUP BY digest),
e AS (SELECT digest, len(sh) AS n, hash(unnest(sh)) AS x FROM u),
p AS (SELECT a.digest AS a, b.digest AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.digest < b.digest GROUP BY ALL),
l AS (
  SELECT a, b FROM p WHERE 100 * common >= 90 * (total - common)
  UNION SELECT x.digest, y.digest FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.digest <> y.digest AND len(x.sh) > 0 AND len(y.sh) > 0
), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a AS start, a AS node FROM g UNION SELECT t.start, g.b FROM t JOIN g ON g.a = t.node),
c AS (SELECT t.start AS digest, min(u.low) AS component FROM t JOIN u ON u.digest = t.node GROUP BY 1)
SELECT k.doc_id, CAST(len(k.sh) AS BIGINT) AS n_shingles, CASE WHEN len(k.sh) = 0 THEN k.doc_id ELSE coalesce(c.component, u.low) END AS component_id
FROM k LEFT JOIN u ON u.digest = k.digest LEFT JOIN c ON c.digest = k.digest
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM d),
c AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), o AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""


def op3() -> str:
    """Offsets as in the operator: running sums of the lengths of gaps and matches. RE2 needs no look-behind to be linear."""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 4 AND coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INTEGER), 0) <= 255))"),
        ("card", r"[0-9]([\x20-]?[0-9])+", "CASE WHEN length(d) BETWEEN 14 AND 19 THEN list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + CAST(d[length(d) - i] AS INTEGER)] ELSE CAST(d[length(d) - i] AS INTEGER) END)) % 10 = 0 ELSE false END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
        ("iban", pii.IBAN.replace("(?:", "("), "around = '' AND list_reduce(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''), lambda c: CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97, 0) = 1"),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "around = '' AND regexp_matches(lower(t[greatest(s - 40, 0) + 1 : s] || chr(10) || t[e + 1 : e + 40]), 'ssn|social security')"),
    ]
    parts = [f"""
      SELECT rid, {k} AS ord, '{name}' AS kind, s, e FROM (
        SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d,
          regexp_replace(CASE WHEN s > 0 THEN t[s] ELSE '' END || t[e + 1 : e + 1], '[^A-Za-z0-9]', '', 'g') AS around
        FROM (
          SELECT rid, t, m, CAST(done + gaps AS BIGINT) AS s, CAST(done + gaps + length(m) AS BIGINT) AS e FROM (
            SELECT rid, t, ms[i] AS m, sum(length(gs[i])) OVER w AS gaps, sum(length(ms[i])) OVER w - length(ms[i]) AS done
            FROM (SELECT rid, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d), LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)
            WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING))))
      WHERE {ok}""" for k, (name, p, ok) in enumerate(kinds)]  # fmt: skip
    span = "kind || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    g AS (
      SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
        count(*) FILTER (kind = 'phone') AS n_phone, string_agg({span}, ',' ORDER BY s, ord) FILTER (ord < 4) AS base, string_agg({span}, ',' ORDER BY s, ord) AS spans
      FROM f GROUP BY rid)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)"""


def op6(rules=url_filter.RULES, damping=url_filter.DAMPING, rounds=url_filter.ROUNDS, least=url_filter.LEAST) -> str:
    """The rounds of the propagation are written out one after the other."""

    def split(url: str) -> str:
        rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        return f"coalesce({rest}, '')"

    host = lambda url: f"translate(regexp_extract({split(url)}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    when = lambda what: " ".join(
        f"WHEN (host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}') THEN '{what(r)}'" for r in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    steps = []
    for i in range(rounds):
        steps.append(f"""m{i} AS (SELECT f.kind, f.dst AS host, s.score * f.share * {damping} AS score FROM flow f JOIN r{i} s ON s.kind = f.kind AND s.host = f.src),
        r{i + 1} AS (SELECT kind, host, sum(score) AS score FROM (
          SELECT z.kind, z.host, z.score * (1 - coalesce(t.went, 0)) AS score FROM r0 z LEFT JOIN (SELECT kind, sum(score) AS went FROM m{i} GROUP BY kind) t ON t.kind = z.kind
          UNION ALL SELECT kind, host, score FROM m{i}) GROUP BY kind, host)""")
    return f"""
    WITH p AS (SELECT page_id, html, {host("url")} AS host, regexp_extract({split("url")}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
    j AS (SELECT *, CASE {when(lambda r: r[1] + r[2])} END AS rule, CASE {when(lambda r: r[0])} END AS by_rule FROM p),
    l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']([a-z][a-z0-9+.-]*://[^"''\\s>]+)', 1)) AS link FROM p),
    e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("link")} AS dst FROM l) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
    h AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'block') AS bad, count(*) FILTER (by_rule = 'allow') AS good FROM j WHERE host <> '' GROUP BY host),
    k AS (SELECT host, CASE WHEN bad * 2 > n THEN 'distrust' WHEN good > 0 THEN 'trust' END AS kind FROM h),
    r0 AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS score FROM k WHERE kind IS NOT NULL),
    flow AS (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e UNION ALL
             SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
    {", ".join(steps)},
    s AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM r{rounds} GROUP BY host),
    n AS (SELECT count(DISTINCT host) AS hosts FROM (SELECT host FROM p UNION ALL SELECT src FROM e UNION ALL SELECT dst FROM e) WHERE host <> '')
    SELECT page_id, j.host AS host, path, rule, CASE WHEN by_rule IS NOT NULL THEN by_rule WHEN s.distrust > s.trust AND s.distrust * n.hosts > {least} THEN 'block' ELSE 'allow' END AS verdict,
      CASE WHEN by_rule IS NULL THEN 'graph' ELSE 'rule' END AS settled_by
    FROM j CROSS JOIN n LEFT JOIN s ON s.host = j.host"""


ORACLE = {"op3_pii": op3(), "op6_url_filter": op6(), "op7_warc": OP7, "op9_exact_topk": OP9, "op11_parity_join": OP11, "op13_fill_middle": OP13}
