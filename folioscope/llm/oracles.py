"""DuckDB SQL for the operators that SQL can express."""

SQL: dict[str, str] = {}

SQL["op10_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS opens, coalesce(role <> lead(role) OVER w, true) AS closes,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\|turn\|>|\|role\|>|\|join\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2', 'g') AS escaped
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN opens THEN 16 + length(role) ELSE 8 END + CASE WHEN closes THEN 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT k, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
g AS (SELECT k, i, list_slice(w, i, i + 7) AS x FROM win),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM g) WHERE n > 1),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT k, line, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY k),
s AS (SELECT lw.k, source, text, n, len(string_split(n, ' ')) AS nw FROM lw JOIN d USING (k)),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
bad AS (SELECT c.source, c.n FROM (SELECT source, n, count(DISTINCT text) AS texts FROM s WHERE nw <= 30 GROUP BY source, n) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.texts > 20 AND c.texts > h.texts * CAST(0.01 AS DOUBLE)),
gone AS (SELECT s.k, sum(s.nw) AS n FROM s JOIN bad ON s.n = bad.n AND s.source IS NOT DISTINCT FROM bad.source WHERE s.nw <= 30 GROUP BY s.k),
f AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_removed_words < CAST(0.2 AS DOUBLE) * n_words) AS kept
FROM f
"""

SQL["op7_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT k, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT k, i, g.n, item_id FROM g JOIN p ON g.x = p.x AND g.n = p.n),
words AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + n)) AS j FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""

SQL["op5_warc_normaliser"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p),
h AS (SELECT *, sha1(html) AS x FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    (CAST(('0x' || substr(x || '00', 1 + 2 * CAST(i * 5 // 8 AS INT), 4)) AS INTEGER) >> CAST(11 - (i * 5) % 8 AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

SQL["op13_fill_in_middle"] = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
x AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM t),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds of assignment and floored means, one after the other."""
    steps = [
        "WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS j, x AS c FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, vec_id, x FROM v ORDER BY h, vec_id LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS MATERIALIZED (SELECT r, j, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n})")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min(d) AS d, min(j) AS j FROM (SELECT *, min(d) OVER (PARTITION BY r) AS m FROM d{n}) WHERE d = m GROUP BY r)")
        if n < rounds:
            steps.append(f"s{n} AS MATERIALIZED (SELECT j, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY j, i)")
            steps.append(f"m{n} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY j)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.j, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (j))")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.j AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""


SQL["op12_elkan_clusters"] = _clusters()
