"""DuckDB SQL for the queries that SQL can express.

Not here: op1 (canonical forms and a catalogue of texts; tested on texts made equal and unequal by hand), op4 (modular prefix arrays), op8 (units'
normalisation) and op9 (sketches), which tests compare with brute-force versions, and op10 (a fitted classifier; tested by held-out accuracy and by what it rejects).
"""

from __future__ import annotations

from . import chat, lines, mixing, secrets

_DOCS = "d AS (SELECT doc_id, source, coalesce(text, '') AS text, text AS raw FROM documents)"

def _op2() -> str:
    shown = "who"
    for c in chat.ESCAPED:
        shown = f"replace({shown}, chr({ord(c)}), '%{ord(c):02X}')"
    return f"""
WITH t AS (SELECT conv_id, turn, role AS who, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who IS DISTINCT FROM 'system'),
e AS (SELECT t.conv_id, speaker, turn, who, raw, text, CASE WHEN who = 'system' THEN 'system' WHEN who IS NOT DISTINCT FROM speaker THEN 'assistant' ELSE 'user' END AS role FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN coalesce(' name=' || {shown}, '') ELSE '' END || chr(10) AS head FROM e),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS place, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS char_end FROM s WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who NULLS FIRST, raw))
SELECT conv_id, speaker, place, turn, role, CASE WHEN role = 'user' THEN who END AS name, segment, (char_end - length(segment))::BIGINT AS char_start, char_end::BIGINT AS char_end,
  CASE WHEN role = 'assistant' THEN (char_end - length(segment) + length(head))::BIGINT END AS train_start, CASE WHEN role = 'assistant' THEN (char_end - 1)::BIGINT END AS train_end FROM o"""


OP3 = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT row_number() OVER () AS k, doc_id, w FROM lowered),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
spots AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT k, i, s.n, item_id FROM spots s JOIN wins USING (n, win)),
cover AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM hits) GROUP BY k),
found AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY k),
toks AS (SELECT k, i, w[i] AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
df AS (SELECT word, count(*) AS df FROM toks GROUP BY word),
own AS (SELECT item_id, word, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), word) AS r FROM (SELECT DISTINCT item_id, unnest(w) AS word FROM items WHERE item_id IS NOT NULL) LEFT JOIN df USING (word)),
rare AS (SELECT item_id, word, r, count(*) OVER (PARTITION BY item_id) AS n FROM own WHERE r <= 4 QUALIFY min(df) OVER (PARTITION BY item_id) > 0),
close AS (SELECT a.k, a.i, x.item_id FROM toks a JOIN rare x ON x.r = 1 AND a.word = x.word JOIN rare o ON o.item_id = x.item_id JOIN toks t ON t.k = a.k AND t.word = o.word AND t.i BETWEEN a.i - 13 AND a.i + 13 GROUP BY a.k, a.i, x.item_id, x.n HAVING count(DISTINCT o.r) = x.n),
near AS (SELECT k, count(DISTINCT item_id) AS n_near FROM close GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_near, 0) AS n_near, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN cover USING (k) LEFT JOIN found USING (k) LEFT JOIN near USING (k)"""

OP5 = f"""
WITH {_DOCS},
q AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS size, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS bare, length(regexp_replace(text, '[\\x20\\x09-\\x0D\\p{{L}}]+', '', 'g')) AS rest FROM d),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5(concat_ws(chr(1), '0', doc_id::VARCHAR, source, md5(text))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / greatest(0.1, coalesce((bare - rest) / nullif(bare, 0), 0.1)) AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ([{', '.join(map(str, mixing.WEIGHTS))}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap <= level * weight AS is_full FROM l),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (SELECT level FROM f WHERE NOT is_full ORDER BY cap / weight, level LIMIT 1) * weight END AS target FROM f),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM g),
r AS (SELECT k.doc_id, k.size, e.source_size, target, epochs, target - epochs * e.source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (start + size / 2 <= rest)::INT))::BIGINT AS taken FROM r"""

OP6 = f"""
WITH l AS (SELECT row_number() OVER () AS k, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT k, doc_id, lines, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM l),
e AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (i > 1 AND (h[i - 1] * 257 + h[i]) % 1000003 % {lines.DIVISOR} = 0)) AS e FROM h),
c AS (SELECT k, doc_id, j, e[j] - CASE WHEN j = 1 THEN 0 ELSE e[j - 1] END AS n, array_to_string(lines[CASE WHEN j = 1 THEN 1 ELSE e[j - 1] + 1 END:e[j]], chr(10)) AS t FROM (SELECT *, unnest(range(1, len(e) + 1)) AS j FROM e)),
m AS (SELECT *, n > 1 AND length(t) >= {lines.MIN_CHARS} AS multi, row_number() OVER (PARTITION BY k, t ORDER BY j) AS nth, min(doc_id) OVER (PARTITION BY t) AS keep FROM c),
x AS (SELECT *, multi AND (nth > 1 OR doc_id > keep) AS gone FROM m)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(t, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS clean_sha256 FROM x GROUP BY k, doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""


def _op7() -> str:
    """Matches come in order, so a match's place is the length of all that stands before it."""
    parts, tables = [], []
    masked = "text"
    for x in secrets.ALLOWED:
        masked = f"regexp_replace({masked}, '{x}', '{' ' * len(x)}', 'gi')"
    for n, kind in enumerate(secrets.KINDS):
        r = secrets.PATTERNS[kind].replace("'", "''")
        text = "masked" if kind == "entropy" else "text"
        tables.append(f"{kind}_m AS (SELECT k, doc_id, j, m[j] AS m, p[j] AS p, g[j] AS g FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT k, doc_id, regexp_extract_all({text}, '{r}') AS m, regexp_split_to_array({text}, '{r}') AS p, regexp_extract_all({text}, '{r}', {2 if kind == 'assign' else 0}) AS g FROM d)))")
        tables.append(f"{kind}_s AS (SELECT *, e - length(m) AS s FROM (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY k ORDER BY j) AS e FROM {kind}_m))")
    least = {"assign": "length(g) >= 12", "access": "length(g) >= 18", "hex": "true"}
    parts = [f"SELECT k, s, {n} AS o, '{kind}' AS kind, e FROM {kind}_s WHERE {least[kind]}" for n, kind in enumerate(secrets.KINDS[:3])]
    w = secrets.WINDOW
    low = " ".join(f"WHEN regexp_full_match(m, '{r}') THEN {secrets.THRESHOLDS[c]}" for c, r in secrets.CLASSES.items())
    tables.append(f"cand AS (SELECT *, CASE {low} ELSE {secrets.THRESHOLDS['base64']} END AS low FROM entropy_s WHERE regexp_matches(m, '[0-9].*[0-9]') AND regexp_matches(m, '[A-Za-z]'))")
    tables.append(f"win AS (SELECT k, s, i, low, list_aggregate(string_split(substr(m, i + 1, {w}), ''), 'entropy') AS h FROM (SELECT *, unnest(range(0, length(m) - {w} + 1)) AS i FROM cand))")
    parts.append(f"SELECT k, s + min(i), 3, 'entropy', s + max(i) + {w} FROM win WHERE h >= low - 1e-9 GROUP BY k, s")
    return f"""
WITH c AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), d AS (SELECT *, {masked} AS masked FROM c), {', '.join(tables)}, found AS ({' UNION ALL '.join(parts)}),
a AS (SELECT k, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans FROM found GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_rotation": _op2(), "op3_decontamination": OP3, "op5_mixing": OP5, "op6_line_dedup": OP6, "op7_secret_scan": _op7()}
