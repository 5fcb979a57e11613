"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tomolake.llm.urlfilter import RULES, Walk

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Components of the join at 0.8 on five-word shingles, by counting shared shingles of every pair.
OP9 = f"""
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
 SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS MATERIALIZED (
 SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
 SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(root, node) AS (SELECT a, b FROM sides UNION SELECT r.root, e.b FROM reach r JOIN sides e ON r.node = e.a),
least AS (SELECT root, min(node) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.root = d.doc_id
"""


def _fits(domain: str, path: str) -> str:
    return f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{path}'))"


def op4(w: Walk = Walk()) -> str:
    """Rules by length, and both walks unrolled round by round."""
    ordered = sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)
    split = [(v, r, *r.partition("/")[::2]) for v, r in ordered]
    rule = "CASE " + " ".join(f"WHEN {_fits(d, '/' + p)} THEN '{r}'" for _, r, d, p in split) + " END"
    ruled = "CASE " + " ".join(f"WHEN {_fits(d, '/' + p)} THEN '{v}'" for v, _, d, p in split) + " END"
    host = lambda c: f"translate(regexp_extract({c}, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    link = """(?i)\\bhref\\s*=\\s*["'']?\\s*([a-z][a-z0-9+.\\-]*://[^"''\\s<>]+)"""
    parts = [
        f"""judged AS MATERIALIZED (SELECT *, {rule} AS rule, {ruled} AS ruled FROM (
 SELECT page_id, coalesce({host('url')}, '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages))""",
        f"""edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT coalesce({host('url')}, '') AS src, {host('l')} AS dst
 FROM (SELECT url, unnest(regexp_extract_all(html, '{link}', 1)) AS l FROM pages)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2)""",
    ]
    for name, verdict, a, b in (("trust", "allow", "src", "dst"), ("distrust", "block", "dst", "src")):
        parts.append(f"""{name}_s AS MATERIALIZED (SELECT host, count(*) / sum(count(*)) OVER () AS seed FROM judged WHERE ruled = '{verdict}' GROUP BY 1)""")
        parts.append(f"""{name}_p AS MATERIALIZED (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS p FROM edges)""")
        parts.append(f"{name}_0 AS (SELECT host, seed AS score FROM {name}_s)")
        for k in range(1, w.rounds + 1):
            parts.append(
                f"""{name}_{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT host, {1 - w.damping!r} * seed AS score FROM {name}_s
 UNION ALL SELECT b, {w.damping!r} * score * p FROM {name}_{k - 1} JOIN {name}_p ON host = a) GROUP BY 1)"""
            )
    last = w.rounds
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN coalesce(d.score, 0) >= {w.floor!r} AND d.score > {w.ratio!r} * coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN trust_{last} t ON t.host = j.host LEFT JOIN distrust_{last} d ON d.host = j.host"""
    )


SQL: dict[str, str] = {"op4_url_filter": op4(), "op9_ngram_jaccard_join": f"SELECT doc_id, n_shingles, component_id FROM ({OP9.strip()})"}
