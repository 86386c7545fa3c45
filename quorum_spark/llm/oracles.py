"""DuckDB SQL of those operators that SQL can express, by query name."""

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
sorted AS (SELECT doc_id, list_sort(s) AS s FROM sets),
reps AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sorted WHERE len(s) > 0 GROUP BY s),
member AS (SELECT doc_id, len(sorted.s) AS n, rep FROM sorted LEFT JOIN reps ON sorted.s = reps.s),
x AS (SELECT rep, n, unnest(s) AS v FROM reps),
pairs AS (SELECT a.rep AS u, b.rep AS v FROM x a JOIN x b ON a.v = b.v AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(node, seen) AS (SELECT rep, rep FROM reps UNION SELECT e.v, r.seen FROM reach r JOIN edges e ON e.u = r.node WHERE r.seen < e.v),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM member LEFT JOIN comp ON node = rep
"""

OP2 = rf"""
WITH words AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM words, unnest(range(1, len(w) - 11)) AS t(i)),
first AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN first USING (g) WHERE first < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS p FROM hit),
left_over AS (SELECT words.doc_id, w, CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END AS k FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM left_over
"""

OP7 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.v, r.seen FROM reach r JOIN links l ON l.u = r.node WHERE r.seen < l.v),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, component = vec_id AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON u = vec_id
"""

OP10 = """
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, role IS NULL AS nobody, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system' AND NOT nobody),
m AS (SELECT conv_id, speaker, turn // 64 AS part, turn, role, text, role = speaker AND NOT nobody AS own,
  '<|im_start|>' || CASE WHEN role = speaker AND NOT nobody THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head FROM t JOIN v USING (conv_id)),
p AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece, sum(length(head) + length(text) + 11) OVER w - length(text) - 11 AS start
  FROM m WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, part::BIGINT AS part, count(*) AS n_messages, count(*) FILTER (own) AS n_trained,
  string_agg(piece, '' ORDER BY turn, role, text) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN start::BIGINT || ':' || (start + length(text))::BIGINT END, ',' ORDER BY turn, role, text), '') AS mask
FROM p GROUP BY conv_id, speaker, part
"""

#: CRC-32 of a string's UTF-8 bytes, by its table of 256 numbers.
_CRC_TABLE = """bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""
_CRC = """xor(list_reduce(list_transform(range(1, length(hex(encode({s}))) // 2 + 1), lambda i: (instr('0123456789ABCDEF', substr(hex(encode({s})), 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({s})), 2 * i, 1)) - 1),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"""

OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(s="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
rows AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM own, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM rows),
found AS (SELECT *, substr(role, 1, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM numbered),
counts AS (SELECT conv_id, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (place > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n FROM found GROUP BY conv_id),
v(conv_id, place, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 't': '', 'r': []::VARCHAR[]}}, {{'c': 1000000000::BIGINT, 't': '', 'r': []::VARCHAR[]}},
    {{'c': 2::BIGINT, 't': 'I', 'r': ['user:']}}, {{'c': 4::BIGINT, 't': 'II', 'r': ['user:', 'assistant:']}} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, place, e, s, u2, least(a1, {{'c': u2.c + 2, 't': u2.t || 'I', 'r': list_append(u2.r, 'assistant:')}}) FROM (
    SELECT conv_id, place, e, s, a1, least(u1, {{'c': e.c + 2, 't': e.t || 'I', 'r': list_append(e.r, 'user:')}}, {{'c': s.c + 2, 't': s.t || 'I', 'r': list_append(s.r, 'user:')}}, {{'c': a1.c + 2, 't': a1.t || 'I', 'r': list_append(a1.r, 'user:')}}) AS u2 FROM (
      SELECT v.conv_id, f.place, {{'c': e.c + 3, 't': e.t || 'D', 'r': e.r}} AS e,
        least({{'c': s.c + 3, 't': s.t || 'D', 'r': s.r}}, {{'c': e.c + CASE WHEN f.c = 's' THEN stay ELSE 1000000000 END, 't': e.t || 'K', 'r': list_append(e.r, line)}}) AS s,
        least({{'c': u.c + 3, 't': u.t || 'D', 'r': u.r}},
          {{'c': e.c + keep_u, 't': e.t || 'K', 'r': list_append(e.r, line)}}, {{'c': s.c + keep_u, 't': s.t || 'K', 'r': list_append(s.r, line)}}, {{'c': a.c + keep_u, 't': a.t || 'K', 'r': list_append(a.r, line)}},
          {{'c': e.c + stay + 2, 't': e.t || 'R', 'r': list_append(e.r, 'user:' || text)}}, {{'c': s.c + stay + 2, 't': s.t || 'R', 'r': list_append(s.r, 'user:' || text)}}, {{'c': a.c + stay + 2, 't': a.t || 'R', 'r': list_append(a.r, 'user:' || text)}}) AS u1,
        least({{'c': a.c + 3, 't': a.t || 'D', 'r': a.r}}, {{'c': u.c + keep_a, 't': u.t || 'K', 'r': list_append(u.r, line)}}, {{'c': u.c + stay + 2, 't': u.t || 'R', 'r': list_append(u.r, 'assistant:' || text)}}) AS a1
      FROM v JOIN (SELECT *, role || ':' || text AS line, stay + CASE WHEN c = 'u' THEN 0 ELSE 1000000000 END AS keep_u, stay + CASE WHEN c = 'a' THEN 0 ELSE 1000000000 END AS keep_a
        FROM (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000000000 END AS stay FROM found)) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.place = v.place + 1))),
done AS (SELECT v.conv_id, gaps, blank, duplicate, truncated, illegal, CASE WHEN n IS NULL THEN {{'c': 0, 't': '', 'r': []}} ELSE least(e, a) END AS best
  FROM v LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM v.conv_id WHERE place = coalesce(n, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.t AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256 FROM done
"""

OP12 = r"""
WITH parsed AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
asked AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&') AS q FROM split),
forms AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^(www|m)\.', '')
  || regexp_replace(rtrim(path, '/'), '\.html$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS form FROM asked),
listed AS (SELECT DISTINCT form FROM forms WHERE regexp_extract(host, '^(?:(?:www|m)\.)?([^.]*)', 1) IN ('spam-farm', 'cheap-pills', 'casino-win', 'adult-x', 'free-bets', 'ads-track')),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled AS (SELECT forms.*, (SELECT max(struct_pack(n := length(h || p), r := h || p, v := v)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM forms)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN form IN (SELECT form FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""

OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, times, {_CRC.format(s="coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY 1),
vocabulary AS (SELECT * FROM words WHERE length(word) >= 5 AND n >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocabulary, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN vocabulary v ON cut.rest = v.word UNION SELECT v.word, cut.word, cut.n FROM cut JOIN vocabulary v ON cut.rest = v.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS b FROM pairs GROUP BY word),
forms AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= 2 * n THEN b.near END AS form, CASE WHEN -b.less >= 2 * n THEN -b.less END::BIGINT AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chain(word, place) AS (SELECT word, word FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON chain.place = forms.word WHERE form IS NOT NULL)
SELECT forms.word, forms.n, forms.n_near, forms.form, forms.form_n, chain.place AS root FROM forms JOIN chain ON chain.word = forms.word JOIN forms last ON last.word = chain.place WHERE last.form IS NULL
"""

SQL = {
    "op1_minhash_near_dedup": OP1, "op2_substring_dedup": OP2, "op7_embedding_near_dedup": OP7, "op10_chat_rotation": OP10,
    "op11_conversation_repair": OP11, "op12_url_filters": OP12, "op13_spelling_variants": OP13,
}
