"""DuckDB text of those queries whose results SQL can express: chat windows, near-duplicates, substrings, repetition."""

from __future__ import annotations

from . import chat, minhash, repetition, suffix_dedup, turn_repair


def chat_sql() -> str:
    escaped = "length({0}) + length(regexp_replace({0}, '[^\\\\<\\[\\]]', '', 'g'))"
    stride = chat.BUDGET - chat.HISTORY - chat.LONGEST
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
n AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\t\\n\\x0B\\f\\r ]')) + {chat.MARKERS} AS tokens,
  {escaped.format("role")} + {escaped.format("text")} + 10 AS chars FROM c),
s AS (SELECT conv_id, min(struct_pack(at := turn, n := tokens)) AS system FROM n WHERE role = 'system' GROUP BY conv_id),
a AS (
  SELECT n.*, greatest({stride} - coalesce(system.n, 0), {chat.LEAST_STRIDE}) AS stride, role = 'system' AND turn IS NOT DISTINCT FROM system.at AS is_system,
    row_number() OVER o AS pos, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) - tokens AS ahead
  FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id WINDOW o AS (PARTITION BY n.conv_id ORDER BY turn NULLS FIRST, role, text)),
w AS (SELECT *, ahead // stride AS win FROM a),
f AS (SELECT DISTINCT conv_id, win FROM w),
lead_turn AS (SELECT conv_id, min_by(win, pos) AS win, min_by(chars, pos) AS chars FROM w WHERE is_system GROUP BY conv_id),
parts AS (
  SELECT conv_id, chars FROM w
  UNION ALL SELECT w.conv_id, chars FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.win = w.win + 1 WHERE NOT is_system AND ahead >= (w.win + 1) * stride - {chat.HISTORY}
  UNION ALL SELECT l.conv_id, chars FROM lead_turn l JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND f.win > l.win),
size AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM parts GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY pos), '') AS target
  FROM w GROUP BY conv_id)
SELECT said.conv_id, n_turns, turns_sha256, length(target)::BIGINT AS loss_chars, sha256(target) AS loss_sha256, formatted_chars
FROM said JOIN size ON said.conv_id IS NOT DISTINCT FROM size.conv_id"""


def near_sql() -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {minhash.WORDS - 1}, least(len(w), 1)) + 1)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {minhash.WORDS - 1}), ' ') AS g FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {minhash.THRESHOLD} * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)"""


def substring_sql() -> str:
    n = suffix_dedup.LENGTH
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, array_slice(b, p, p + {n - 1}) AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {n - 2})) AS p FROM d WHERE octet_length(b) >= {n})),
m AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id),
r AS (SELECT doc_id, p, sum(CASE WHEN p - before <= {n} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM m)),
s AS (SELECT doc_id, min(p) AS lo, max(p) + {n} AS hi FROM r GROUP BY doc_id, run),
gone AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS a, lo - 1 AS z FROM s
  UNION ALL SELECT doc_id, max(hi), NULL FROM s GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(CASE WHEN a > coalesce(z, octet_length(b)) THEN ''::BLOB ELSE array_slice(b, a, coalesce(z, octet_length(b))) END), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def repetition_sql() -> str:
    """Words get ranks of their first 2**k words by doubling; the longest repeat is found from the highest k down."""
    steps, top = [], 15
    for k in range(top):
        steps.append(f"r{k + 1} AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY r, s) AS r FROM (SELECT doc_id, i, r, lead(r, {1 << k}) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM r{k}) WHERE s IS NOT NULL)")
    steps.append(f"s{top} AS (SELECT doc_id, i, 0 AS n, 0 AS c FROM r0)")
    for k in range(top - 1, -1, -1):
        steps.append(
            f"s{k} AS (SELECT doc_id, i, CASE WHEN more THEN n + {1 << k} ELSE n END AS n, CASE WHEN more THEN dense_rank() OVER (ORDER BY c, r) ELSE c END AS c"
            f" FROM (SELECT *, bool_or(r IS NOT NULL AND same > 1) OVER (PARTITION BY doc_id) AS more"
            f" FROM (SELECT s.*, r.r, count(*) OVER (PARTITION BY s.doc_id, s.c, r.r) AS same FROM s{k + 1} s LEFT JOIN r{k} r ON r.doc_id = s.doc_id AND r.i = s.i + s.n))"
            f" WHERE NOT more OR r IS NOT NULL)"
        )

    def cover(n: int) -> str:
        return f"(SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range({n})) AS k FROM w{n} WHERE same > 1) GROUP BY doc_id)"

    least = repetition.MIN_WORDS
    assert least == 8, "windows of eight words are r3"
    words = "'[^\\x20\\x09-\\x0D]+'"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {words}) AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
r0 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY word) AS r FROM each),
{", ".join(steps)},
w5 AS (SELECT a.doc_id, a.i, count(*) OVER (PARTITION BY a.doc_id, a.r, b.r) AS same FROM r2 a JOIN r0 b ON b.doc_id = a.doc_id AND b.i = a.i + 4),
w8 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS same FROM r3),
longest AS (SELECT doc_id, max(n) AS n FROM s0 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {words}) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(f.n, 0) AS n_repeat_words, coalesce(e.n, 0) AS covered_words, coalesce(g.n, 0)::BIGINT AS longest_repeat
  FROM d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN {cover(5)} f ON f.doc_id = d.doc_id LEFT JOIN {cover(least)} e ON e.doc_id = d.doc_id LEFT JOIN longest g ON g.doc_id = d.doc_id),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND covered_words <= {repetition.COVERED}::DOUBLE * n_words AND longest_repeat <= {repetition.LONGEST} AS kept FROM v"""


#: A table of one row with the words of CRC-32 in ``crc.t``.
CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32_sql(key: str) -> str:
    """The unsigned CRC-32 of an ASCII text, beside ``crc``."""
    codes = f"list_transform(string_split({key}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295)"


def repair_sql() -> str:
    """Costs and least letters row by row: for each state of the grammar the best of all edits, with up to two insertions before each."""
    values = []
    for q in range(turn_repair.STATES):
        state, made = q, "''"
        for k in range(3):
            values.append(f"({q}, {state}, {k * turn_repair.INSERT}, '{'I' * k}', {made})")
            made, state = f"{made} || chr(10) || '{turn_repair.ROLE[state]}:'", turn_repair.NEXT[state]
    nexts = ", ".join(map(str, turn_repair.NEXT))
    roles = ", ".join(f"'{r}'" for r in turn_repair.ROLE)
    return f"""
WITH RECURSIVE {CRC},
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations, crc),
g AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM g),
f AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM f),
counted AS (
  SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
inserted AS (SELECT * FROM (VALUES {", ".join(values)}) AS v(q, s, cost, said, made)),
moved AS (
  SELECT r.conv_id, r.i, n.q, m.state, n.cost + m.cost AS cost, n.said || m.letter AS said, n.made || m.made AS made
  FROM r, inserted n, LATERAL (
    SELECT n.s AS state, {turn_repair.DELETE} AS cost, 'D' AS letter, '' AS made
    UNION ALL SELECT [{nexts}][n.s + 1], {turn_repair.REROLE} + CASE WHEN r.fault = 'truncated' THEN {turn_repair.TRUNCATED} ELSE 0 END, 'R', chr(10) || [{roles}][n.s + 1] || ':' || r.text WHERE r.fault IS NULL OR r.fault = 'truncated'
    UNION ALL SELECT CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN r.fault = 'truncated' THEN {turn_repair.TRUNCATED} ELSE 0 END, 'K', chr(10) || r.role || ':' || r.text
      WHERE (r.fault IS NULL OR r.fault = 'truncated') AND (r.initial = 's' AND n.s = 0 OR r.initial = 'u' AND n.s <> 2 OR r.initial = 'a' AND n.s = 2)) m),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'said': '', 'made': ''}} AS b FROM conversations
  UNION ALL
  SELECT conv_id, i, state, min(b) FROM (
    SELECT best.conv_id, moved.i, moved.state, {{'cost': best.b.cost + moved.cost, 'said': best.b.said || moved.said, 'made': best.b.made || moved.made}} AS b
    FROM best JOIN moved ON moved.conv_id IS NOT DISTINCT FROM best.conv_id AND moved.i = best.i + 1 AND moved.q = best.q) GROUP BY conv_id, i, state),
ended AS (
  SELECT conv_id, min({{'cost': best.b.cost + n.cost, 'said': best.b.said || n.said, 'made': best.b.made || n.made}}) AS b
  FROM best JOIN inserted n USING (q) WHERE n.s IN (0, 3) AND i = (SELECT count(*) FROM r WHERE r.conv_id IS NOT DISTINCT FROM best.conv_id) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost::BIGINT AS cost, b.said AS audit, sha256(b.made[2:]) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def trie_sql() -> str:
    return f"""
WITH {CRC},
t AS (
  SELECT conv_id, md5(length(r) || ':' || r || x) AS id, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM t),
c AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM p), crc),
b AS (
  SELECT c.conv_id, 0 AS part, pos, id, words FROM c JOIN p ON p.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, id, words FROM c JOIN p USING (conv_id) WHERE pos >= h),
d AS (SELECT conv_id, words, row_number() OVER w AS depth, list(id) OVER w AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, words, depth, path FROM d UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY depth, path),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
a AS (SELECT path[:j] AS path, (n_convs - 1) * words AS saved, n_children = 0 AS leaf FROM (SELECT *, unnest(range(depth + 1)) AS j FROM f)),
s AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM a GROUP BY path),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN f u ON u.depth = f.depth - 1 AND u.path = f.path[:f.depth - 1]"""


ORACLES: dict[str, str] = {
    "op4_chat_windows": chat_sql(),
    "op7_minhash_near_dedup": near_sql(),
    "op8_suffix_dedup_bwt": substring_sql(),
    "op9_quality_repetition": repetition_sql(),
    "op11_turn_repair": repair_sql(),
    "op13_prefix_trie": trie_sql(),
}
