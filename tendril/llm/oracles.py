"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding AS e FROM embeddings),
u AS (SELECT vec_id, CAST(e AS DOUBLE[]) AS e FROM v WHERE e IS NOT NULL AND len(e) > 0
   AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND (list_cosine_similarity(a.e, b.e) >= 0.9 OR a.e = b.e)),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
c AS (SELECT a, min(c) AS c FROM r GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
      FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS s
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, sizes WHERE len(w) >= m)),
o AS (SELECT g.doc_id, g.k, g.m, p.item FROM g JOIN p USING (m, s)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM (SELECT DISTINCT doc_id, k, m FROM o)) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS pos FROM r WHERE n > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
j AS (SELECT p.doc_id, p.word, p.pos, c.pos IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM j GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

_ESCAPED = "replace(replace(replace(replace(replace({}, '~', '~0'), '</s>', '~1'), '<s>', '~2'), '[INST]', '~3'), '[/INST]', '~4')"

OP5 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM c),
n AS (SELECT *, k = 0 AND role = 'system' AS leads, (length(text) + 3) // 4 + 4 AS own FROM k),
t AS (SELECT *, CASE WHEN leads THEN 0 ELSE own END AS tokens, max(CASE WHEN leads THEN own END) OVER (PARTITION BY conv_id) AS sys_tokens,
      max(CASE WHEN leads THEN text END) OVER (PARTITION BY conv_id) AS sys FROM n),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) - tokens AS before, greatest(32, (384 - coalesce(sys_tokens, 0)) // 2) AS share FROM t),
w AS (SELECT *, before // share AS win FROM b),
x AS (SELECT *, min(win) OVER l AS nxt, min(before) OVER l AS nxt_start FROM w WINDOW l AS (PARTITION BY conv_id ORDER BY win RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT conv_id, sum(length(role_e) + length(text_e) + 8) AS chars FROM (
      SELECT conv_id, replace({_ESCAPED.format("role")}, chr(10), '~n') AS role_e, {_ESCAPED.format("text")} AS text_e FROM (
        SELECT conv_id, role, text FROM x
        UNION ALL SELECT conv_id, role, text FROM x WHERE nxt IS NOT NULL AND before >= nxt_start - least(128, share) AND NOT leads
        UNION ALL SELECT conv_id, 'system', sys FROM (SELECT DISTINCT conv_id, win, sys FROM x WHERE win > 0 AND sys IS NOT NULL))) GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(any_value(chars) AS BIGINT) AS formatted_chars
FROM x JOIN f USING (conv_id) GROUP BY conv_id
"""

#: The schedule is run slot by slot: the state is the number of blocks that each source has placed, and how many are missing.
_MIX = """
c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM {docs} GROUP BY 1),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS k FROM c),
li AS (SELECT list(s ORDER BY s) AS ss, list(CAST(9 * n * k + total AS HUGEINT) ORDER BY s) AS ws, list((n + 15) // 16
   ORDER BY s) AS need, CAST(any_value(10 * total * k) AS HUGEINT) AS whole FROM c, tot),
run AS (SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS pick, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done, CAST(list_sum(need) AS BIGINT) AS missing FROM li
  UNION ALL
  SELECT slot + 1, p, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), missing - CASE WHEN done[p] < need[p] THEN 1 ELSE 0 END FROM (
    SELECT slot, done, missing, need, list_position(d, list_min(d)) AS p FROM (
      SELECT slot, done, missing, need, list_transform(done, lambda x, i:
   CASE WHEN x * whole // ws[i] <= slot + 1 THEN ((x + 1) * whole + ws[i] - 1) // ws[i] ELSE 4611686018427387904 END) AS d
      FROM run, li WHERE missing > 0))),
pl AS (SELECT ss[pick] AS s, done[pick] - 1 AS i, slot FROM run, li WHERE slot >= 0),
bl AS (SELECT s, count(*) AS blocks FROM pl GROUP BY 1),
rk AS (SELECT *, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM {docs}),
nth AS (SELECT rk.*, r + n * unnest(range(0, CAST(greatest(1, (blocks * 16 - 1 - r) // n + 1) AS BIGINT))) AS m FROM rk JOIN bl USING (s) JOIN c USING (s)),
placed AS (SELECT nth.*, slot, m % 16 AS place FROM nth JOIN pl ON pl.s = nth.s AND pl.i = m // 16)
"""

OP6 = f"""
WITH RECURSIVE {_MIX.format(docs="documents")}
SELECT doc_id, s AS source, CAST(slot AS BIGINT) AS slot, CAST(place AS BIGINT) AS place, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM placed
"""

OP9 = """
WITH o AS (SELECT page_id, url, html, CAST(coalesce(floor(page_id / 4096), -1) AS BIGINT) AS shard FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY page_id NULLS FIRST, url NULLS FIRST, html NULLS FIRST) - 1 AS ordinal FROM o),
m AS (SELECT *, md5(shard || '/' || ordinal) AS h FROM k),
r AS (SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
  || 'WARC-Record-ID: <urn:uuid:' || h[1:8] || '-' || h[9:12] || '-3' || h[14:16] || '-8' || h[18:20] || '-' || h[21:] || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM m)
SELECT page_id, shard, ordinal, CAST(sum(strlen(rec)) OVER w - strlen(rec) AS BIGINT) AS "offset", CAST(strlen(rec) AS BIGINT) AS length,
       sha256(rec) AS sha256, coalesce(page_id % 97 = 13, false) AS damaged
FROM r WINDOW w AS (PARTITION BY shard ORDER BY ordinal ROWS UNBOUNDED PRECEDING)
"""

OP12 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim({_LOWER.replace("coalesce(text, '')", "line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, pos, line, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

def _edit(cost: str, letter: str, line: str, after: str) -> str:
    """What a way costs, its edits and its text, where ``after`` is that of the rows to come."""
    return f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 'r': {line} || {after}.r}}"


def _choices(state: str, due: str, word: str, keeps: dict[str, str]) -> str:
    """The least way from a state at a row that may stay: delete it, give it the role that is due, or keep it."""
    kept = " ".join(f"WHEN i = '{i}' THEN [{_edit('p', 'K', 'said', to)}]" for i, to in keeps.items())
    given = _edit("1 + p", "R", f"chr(10) || '{word}:' || text", due)
    return f"list_min(list_concat([{_edit('2', 'D', repr(''), state)}, {given}], CASE {kept} ELSE [] END))"


def _insert(words: list[str], after: str) -> str:
    return _edit(str(5 * len(words)), "I" * len(words), " || ".join(f"chr(10) || '{w}:'" for w in words), after)


_FORCED = ", ".join(_edit("2", "D", "''", f"n{k}") + f" AS n{k}" for k in range(4))

#: Ways are followed from the last row to the first; a way is (cost, edits, text) and the least of them is the one that counts.
OP13 = f"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([CAST(n AS BIGINT)], range(8)), lambda c, k:
   CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n))),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
          lambda c, b: xor(c // 256, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 20 AS kind FROM conversations, tbl),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user'
   ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id
   ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, role[1:1] AS i FROM dam),
f AS (SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv_id, role, text
   ORDER BY k) > 1 AS dup, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM o),
g AS (SELECT *, NOT blank AND NOT dup AND core[-1:] NOT IN ('.', '!', '?') AS cut FROM f),
b AS (SELECT conv_id, k, i, blank OR dup AS forced, CASE WHEN cut THEN 5 ELSE 0 END AS p, chr(10) || role || ':' || text AS said, text FROM g),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
      count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k FROM g GROUP BY 1),
w AS (SELECT conv_id, k + 1 AS k, {{'c': 0, 'a': '', 'r': ''}} AS n0, {{'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS n1,
      {{'c': 5, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS n2, {{'c': 0, 'a': '', 'r': ''}} AS n3 FROM s
  UNION ALL
  (WITH x AS (SELECT b.*, n0, n1, n2, n3 FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.k = w.k - 1),
  y AS (SELECT conv_id, k, {_choices("n0", "n2", "user", {"s": "n1", "u": "n2"})} AS b0, {_choices("n1", "n2", "user", {"u": "n2"})} AS b1,
        {_choices("n2", "n3", "assistant", {"a": "n3"})} AS b2, {_choices("n3", "n2", "user", {"u": "n2"})} AS b3 FROM x WHERE NOT forced)
  SELECT conv_id, k, {_FORCED} FROM x WHERE forced
  UNION ALL
  SELECT conv_id, k, list_min([b0, {_insert(["user"], "b2")}, {_insert(["user", "assistant"], "b3")}]), list_min([b1, {_insert(["user"], "b2")}, {_insert(["user", "assistant"], "b3")}]),
         list_min([b2, {_insert(["assistant"], "b3")}]), list_min([b3, {_insert(["user"], "b2")}]) FROM y)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(CAST(gaps AS BIGINT), 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(n0.c, 0) AS BIGINT) AS cost, coalesce(n0.a, '') AS audit, sha256(coalesce(n0.r[2:], '')) AS repaired_sha256
FROM ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM ids.conv_id AND w.k = 1
"""

ORACLES: dict[str, str] = {
    "op1_jaccard": OP1,
    "op2_embeddings": OP2,
    "op3_decontaminate": OP3,
    "op4_substrings": OP4,
    "op5_chat": OP5,
    "op6_mixing": OP6,
    "op9_warc": OP9,
    "op12_lines": OP12,
    "op13_repair": OP13,
}
