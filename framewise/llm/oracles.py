"""DuckDB SQL that the queries of this subpackage must agree with, where SQL can express their method's result."""

from __future__ import annotations

#: Sets of word shingles joined on shared ones, links of 0.8 or more, classes by reachability.
NGRAM_JOIN = r"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\x0B\f\r ]+'), lambda x: x != '') AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [''] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g, len(w) AS n FROM d),
e AS (SELECT r, unnest(g) AS x FROM s), both_ AS (SELECT a.r AS a, z.r AS z, count(*) AS k FROM e a JOIN e z ON a.x = z.x AND a.r < z.r GROUP BY 1, 2),
l AS (SELECT a, z FROM both_ JOIN s p ON p.r = a JOIN s q ON q.r = z WHERE (p.n < 5) = (q.n < 5) AND k >= 0.8 * (len(p.g) + len(q.g) - k) - 1e-9), u AS (SELECT a, z FROM l UNION ALL SELECT z, a FROM l),
c(r, m) AS (SELECT r, r FROM d UNION SELECT u.z, c.m FROM c JOIN u ON u.a = c.r), k AS (SELECT c.r, min(d.doc_id) AS class_id FROM c JOIN d ON d.r = c.m GROUP BY 1)
SELECT doc_id, class_id, (SELECT count(*) FROM u WHERE u.a = d.r) AS n_links FROM d JOIN k USING (r)"""

#: All strings of 50 bytes (100 hex digits) with their least document; covered runs by gaps and islands.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i, h FROM d), g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY 1), t AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g JOIN f USING (s) WHERE least < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM t) GROUP BY doc_id, n), q AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last_ FROM r),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS stop, string_agg(substr(h, 2 * last_ + 1, 2 * (a - last_)), '' ORDER BY a) AS front FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

#: SHA-1 in base 32 and the least page of each payload.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), x AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first_ FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first_ THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first_ THEN first_ END AS refers_to FROM x"""

def _edits() -> str:
    """Body of the fold over a conversation's rows: for each state (z nothing, s, u, a stands last) the cheapest edits."""
    allowed = lambda letters, cost: f"CASE WHEN lower(x.l) IN ({letters}) THEN {cost} + CASE WHEN x.l = lower(x.l) THEN 0 ELSE 3 END ELSE 1000000000000 END"
    put = lambda q, cost, edit, out: f"{{'c': p.{q}.c + {cost}, 'a': p.{q}.a || '{edit}', 'o': {out}}}"
    least = lambda *found: f"list_sort([{', '.join(found)}])[1]"
    said = lambda q, role: f"list_append(p.{q}.o, {role} || ':' || x.t)"
    drop = lambda q: put(q, 4, "D", f"p.{q}.o")
    keep = lambda q, letter: put(q, allowed(f"'{letter}'", 0), "K", said(q, "x.r"))
    give = lambda q, role: put(q, allowed("'s', 'u', 'a', 'x'", 3), "R", said(q, f"'{role}'"))
    more = lambda q, role: put(q, 3, "I", f"list_append(p.{q}.o, '{role}:')")
    row = f"""{{'z': {drop("z")}, 's': {least(drop("s"), keep("z", "s"))},
        'u': {least(drop("u"), *(keep(q, "u") for q in "zsa"), *(give(q, "user") for q in "zsa"))}, 'a': {least(drop("a"), keep("u", "a"), give("u", "assistant"))}}}"""
    ask = f"{{'z': p.z, 's': p.s, 'u': {least('p.u', *(more(q, 'user') for q in 'zsa'))}, 'a': p.a}}"
    answer = f"{{'z': p.z, 's': p.s, 'u': p.u, 'a': {least('p.a', more('u', 'assistant'))}}}"
    return f"list_transform(list_transform([{row}], lambda p: {ask}), lambda p: {answer})[1]"


_UNSEEN = "{'c': 1000000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}"
#: crc32 bit by bit; faults by row; the cheapest edits folded over each conversation's rows.
CONVERSATION_REPAIR = rf"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
b AS (SELECT * EXCLUDE h, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, y: list_reduce(range(8), lambda v, j: xor(v >> 1, 3988292384 * (v & 1)), xor(c, y)), 4294967295), 4294967295) % 20 AS kind FROM k),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n FROM b),
o AS (SELECT *, rtrim(text, e' \t\n\x0B\f\r') AS ink, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i FROM e),
f AS (SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS c FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'l': CASE fault WHEN 'none' THEN c WHEN 'truncated' THEN upper(c) ELSE 'd' END, 'r': role, 't': text}} ORDER BY i) AS rows_ FROM f GROUP BY conv_id),
s AS (SELECT * EXCLUDE rows_, list_reduce(rows_, lambda p, x: {_edits()}, {{'z': {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}}, 's': {_UNSEEN}, 'u': {{'c': 3::BIGINT, 'a': 'I', 'o': ['user:']}}, 'a': {{'c': 6::BIGINT, 'a': 'II', 'o': ['user:', 'assistant:']}}}}) AS p FROM g),
t AS (SELECT * EXCLUDE p, list_sort([p.z, p.a])[1] AS w FROM s)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id"""

#: All windows of 13 words with their least document; covered words of each text.
SUBSTRING_DEDUP = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x != '') AS w FROM documents), p AS (SELECT doc_id, unnest(range(1, greatest(1, len(w) - 11))) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p), f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY 1), c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN f USING (s) WHERE least < doc_id GROUP BY 1),
k AS (SELECT doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""

ORACLES = {"op4_ngram_join": NGRAM_JOIN, "op6_suffix_dedup": SUFFIX_DEDUP, "op9_warc": WARC, "op11_conversation_repair": CONVERSATION_REPAIR, "op13_substring_dedup": SUBSTRING_DEDUP}
