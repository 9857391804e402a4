"""DuckDB SQL for the rows of those operator queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, contracts, licenses

_T = chat.INST


def _op1() -> str:
    width = sum(map(len, _T.controls))
    q = contracts.CONFLICT.replace("'", "''")
    # A backslash goes after the first character of each control string, escaped ones included.
    esc = r"regexp_replace(regexp_replace({0}, '(<)(\\*/?s>)', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '{q}'), (-7::BIGINT, 1::BIGINT, 'assistant', '{q}')),
e AS (SELECT *, {width} + length({esc.format("role")}) + length({esc.format("text")}) AS w FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(w)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for find, put in licenses.SPELLINGS:
        out = f"replace({out}, '{find}', '{put}')"
    for pattern, put in licenses.CANON:
        put = "' '" if put == " " else "chr(10)" if put == r"\n" else "'" + put.replace("'", "''") + "'"
        out = f"regexp_replace({out}, '{pattern}', {put}, 'g')"
    return f"trim({out})"


def _texts(known: dict) -> str:
    rows = [(k, t) for k, texts in sorted(known.items()) for t in ([texts] if isinstance(texts, str) else texts)]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "VALUES " + ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in rows)


def _op2() -> str:
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({_canonical("t")}) AS d FROM ({_texts(licenses.LICENSES)}) v(license, t)),
notice AS (SELECT DISTINCT license, sha256({_canonical("t")}) AS d FROM ({_texts(licenses.NOTICES)}) v(license, t)),
doc AS (SELECT doc_id, text, CASE WHEN {_canonical("text")} <> '' THEN sha256({_canonical("text")}) END AS license_digest FROM documents),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
hit AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, sha256({_canonical("t")}) AS d FROM line WHERE contains(lower(t), 'licen')) JOIN notice USING (d)),
per AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc.doc_id, license_digest, known.license, coalesce(per.notices, '') AS notices, coalesce(per.n, 0) AS n_notices
FROM doc LEFT JOIN known ON known.d = doc.license_digest LEFT JOIN per ON per.doc_id = doc.doc_id"""


_OP6 = r"""
WITH bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spot AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT DISTINCT doc_id, i, spot.n, item FROM spot JOIN win ON win.n = spot.n AND win.k = array_to_string(w[i:i + spot.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP9 = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM dw UNION SELECT reach.a, link.y FROM reach JOIN link ON link.x = reach.b)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = dw.doc_id"""

_OP11 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM dw WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM dw),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM dw LEFT JOIN kept USING (doc_id)"""

ORACLES = {"op1_chat_formatting": _op1(), "op2_license_scan": _op2(), "op6_decontamination": _OP6, "op9_jaccard_join": _OP9, "op11_substring_dedup": _OP11}
