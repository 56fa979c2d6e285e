"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from curata.llm import collocations, source_divergence, url_graph
from curata.llm.chat_schema import Template


def _split(url: str) -> tuple[str, str]:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*'), '{url_graph.UPPER}', '{url_graph.LOWER}')"
    return host, f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    host, path = _split("coalesce(url, '')")
    to, _ = _split("CASE WHEN link[1:2] = '//' THEN ':' || link ELSE link END")
    link = url_graph.LINK.replace("'", "''")
    rule_rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    d = url_graph.DAMPING
    steps = [f"s0 AS (SELECT host, kind, score * (1 - {d}) AS score FROM seeds)"]
    for i in range(url_graph.STEPS):
        steps.append(f"""s{i + 1} AS (SELECT host, kind, sum(score) AS score FROM (
            SELECT * FROM s0 UNION ALL SELECT w.b, w.kind, w.weight * s.score FROM ways w JOIN s{i} s ON s.host = w.a AND s.kind = w.kind) GROUP BY 1, 2)""")
    return f"""
WITH urls AS (SELECT page_id, html, {host} AS host, {path} AS path FROM pages),
rules(h, p, v) AS (VALUES {rule_rows}),
keyed AS (SELECT row_number() OVER () AS k, * FROM urls),
fits AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM keyed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
judged AS (SELECT keyed.*, rule, v FROM keyed LEFT JOIN fits USING (k)),
links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM judged),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {to} AS dst FROM links) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
ways AS (SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) * {d} AS weight FROM edges
    UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) * {d} FROM edges),
shares AS (SELECT host, avg((coalesce(v, '') = 'allow')::int) AS trust, avg((coalesce(v, '') = 'block')::int) AS distrust FROM judged WHERE host <> '' GROUP BY 1),
seeds AS (SELECT host, 'trust' AS kind, trust AS score FROM shares WHERE trust > 0 UNION ALL SELECT host, 'distrust', distrust FROM shares WHERE distrust > 0),
{', '.join(steps)},
hosts AS (SELECT host, sum(score) FILTER (kind = 'distrust') > {url_graph.THRESHOLD} * sum(score) AS blocked FROM (
    SELECT * FROM s{url_graph.STEPS} UNION ALL SELECT host, 'neutral', (1 - trust - distrust) * (1 - {d}) FROM shares) GROUP BY 1)
SELECT page_id, judged.host AS host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN hosts ON judged.host = hosts.host"""


def chat_formatting() -> str:
    t = Template()

    def escaped(x: str, role: bool) -> str:
        x = f"replace({x}, '&', '&amp;')"
        for c in (*t.control, *(["\n"] if role else [])):
            x = f"replace({x}, '{c}', '&#{ord(c[0])};{c[1:]}')"
        return x

    each = len(t.start) + 1 + len(t.tail)
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({escaped('role', True)}) + length({escaped('text', False)}) + {each})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


def substring_dedup(width: int = 13) -> str:
    return f"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT k, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
windows AS (SELECT k, doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') AS s FROM (
    SELECT k, doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS i FROM texts)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT k, i + j AS i FROM windows JOIN firsts USING (s), range({width}) r(j) WHERE doc_id > least),
kept AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (k)"""


def source_divergence_audit() -> str:
    d = source_divergence
    p = "1 + ({scale}::HUGEINT * ({c} + 2)) // ({n} + 2::HUGEINT * {v})"
    own = p.format(scale=d.SCALE, c="coalesce(c, 0)", n="n", v="v")
    whole = p.format(scale=d.SCALE, c="c", n="n", v="v")
    f = "((a.p - b.p) * (a.p - b.p) // (a.p + b.p))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{d.UPPER}', '{d.LOWER}'), '{d.TERM}') AS terms FROM documents),
tokens AS (SELECT k, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT k) >= {d.MIN_DF}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
counts AS (SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
group_n AS (SELECT lang, source, coalesce(sum(c), 0) AS n, coalesce(any_value(v), 0) AS v
    FROM groups LEFT JOIN counts USING (lang, source) LEFT JOIN sizes USING (lang) GROUP BY 1, 2),
shares AS (SELECT lang, source, term, coalesce(c, 0) AS c, {own} AS p
    FROM group_n JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
lang_counts AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY 1, 2),
lang_shares AS (SELECT lang, term, {whole} AS p FROM lang_counts JOIN (SELECT lang, sum(c) AS n FROM lang_counts GROUP BY 1) USING (lang) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum({f}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT a.lang, a.source, 'term' AS part, a.term AS item, {f} AS value FROM shares a JOIN lang_shares b USING (lang, term) WHERE c > 0 AND a.p > b.p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {d.TOP_TERMS}"""


def phrase_collocations() -> str:
    c = collocations
    lower = f"translate(coalesce(text, ''), '{url_graph.UPPER}', '{url_graph.LOWER}')"
    cut = "({scale}::HUGEINT * a * a // ({l}::HUGEINT * {r}))"
    cuts2 = f"[{{'score': {cut.format(scale=c.SCALE, l='l1', r='r1')}, 'k': 1, 'l': l1, 'r': r1}}]"
    cuts3 = f"[{{'score': {cut.format(scale=c.SCALE, l='l1', r='r1')}, 'k': 1, 'l': l1, 'r': r1}}, {{'score': {cut.format(scale=c.SCALE, l='l2', r='r2')}, 'k': 2, 'l': l2, 'r': r2}}]"
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
f1 AS (SELECT lang, w, count(*) AS a FROM (SELECT lang, unnest(w) AS w FROM ws) GROUP BY 1, 2),
totals AS (SELECT lang, sum(a) AS n FROM f1 GROUP BY 1),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM ws) GROUP BY 1, 2, 3 HAVING count(*) >= {c.LEAST}),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM ws) GROUP BY 1, 2, 3, 4 HAVING count(*) >= {c.LEAST}),
inside AS (SELECT lang, x, y, max(a) AS most FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY 1, 2, 3),
c2 AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, u.a AS l1, v.a AS r1 FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.w = f2.x JOIN f1 v ON v.lang = f2.lang AND v.w = f2.y
    LEFT JOIN inside i ON i.lang = f2.lang AND i.x = f2.x AND i.y = f2.y WHERE i.most IS NULL OR 100 * i.most < {c.ABSORBED} * f2.a),
c3 AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.a, u.a AS l1, yz.a AS r1, xy.a AS l2, v.a AS r2 FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.w = f3.x JOIN f1 v ON v.lang = f3.lang AND v.w = f3.z
    JOIN f2 xy ON xy.lang = f3.lang AND xy.x = f3.x AND xy.y = f3.y JOIN f2 yz ON yz.lang = f3.lang AND yz.x = f3.y AND yz.y = f3.z),
cut AS (SELECT lang, phrase, a, list_sort({cuts2})[1] AS c FROM c2 UNION ALL SELECT lang, phrase, a, list_sort({cuts3})[1] AS c FROM c3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, phrase) AS rank FROM cut)
SELECT lang, rank, phrase, a, c.l AS l, c.r AS r, n::BIGINT AS n, c.score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {c.TOP}"""
