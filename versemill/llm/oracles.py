"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(k % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM sources
), stepped AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(lev) OVER ()) AS target,
         ('0x' || substr(md5('17:' || coalesce(source, '') || CASE WHEN source IS NULL THEN '?' ELSE '' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM stepped
), ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - 1 AS i
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (least(floor((i + 1) * rate + u) - floor(i * rate + u), 3))::BIGINT * size AS taken FROM ranked
"""

ORACLES["op4_format_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(coalesce(role, '')) + length(text) + len(regexp_extract_all(text, '<\\*/?turn>')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES["op2_top_k"] = r"""
WITH valid AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.row <> q.row AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

ORACLES["op9_quality_rules"] = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), covered AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows), range(0, 3) t(k) WHERE c > 1 GROUP BY r
), stats AS (
  SELECT s.r, s.doc_id, s.lang, s.text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split s LEFT JOIN covered c ON c.r = s.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN ceil(200 * n_symbols / word_chars) ELSE 0 END::BIGINT AS symbols, CASE WHEN n_lines > 0 THEN ceil(200 * n_dup_lines / n_lines) ELSE 0 END::BIGINT AS dup_lines,
    CASE WHEN n_words > 0 THEN ceil(200 * n_repeat_words / n_words) ELSE 0 END::BIGINT AS repeats, CASE WHEN n_words > 0 THEN ceil(10 * word_chars / n_words) ELSE 0 END::BIGINT AS word_length FROM stats
), marked AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) IS NOT NULL
), trials AS (
  SELECT lang, text, min(quality) >= 1 AS good, max(symbols) AS symbols, max(dup_lines) AS dup_lines, max(repeats) AS repeats, max(word_length) AS word_length
  FROM judged JOIN marked USING (doc_id) WHERE NOT base_failed GROUP BY lang, text
), steps AS (
  SELECT lang, rule, step, sum(good::INT) AS g, sum((NOT good)::INT) AS b FROM (UNPIVOT trials ON symbols, dup_lines, repeats, word_length INTO NAME rule VALUE step) GROUP BY lang, rule, step
), cells AS (
  SELECT *, sum(g) OVER (PARTITION BY lang, rule) AS n, coalesce(sum(g) OVER stricter, 0) AS lost, coalesce(sum(b) OVER stricter, 0) AS caught FROM steps
  WINDOW stricter AS (PARTITION BY lang, rule ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tests AS (
  SELECT *, 0.05 / count(*) OVER () AS level FROM (SELECT DISTINCT lang, rule, n FROM cells)
), tails AS (
  SELECT lang, rule, level, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.005) + (n - k) * ln(0.995))) OVER (PARTITION BY lang, rule ORDER BY k) AS p
  FROM (SELECT *, unnest(range(0, floor(n * 0.005)::BIGINT + 1)) AS k FROM tests)
), most AS (
  SELECT lang, rule, max(k) AS most FROM tails WHERE p <= level GROUP BY lang, rule
), cuts AS (
  SELECT c.lang, c.rule, max(struct_pack(caught := caught, step := step)).step AS cut FROM cells c JOIN most m ON c.lang IS NOT DISTINCT FROM m.lang AND c.rule = m.rule WHERE lost <= most AND caught > 0 GROUP BY c.lang, c.rule
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.lang IS NOT DISTINCT FROM j.lang AND CASE c.rule WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines WHEN 'repeats' THEN repeats ELSE word_length END > c.cut) AS kept
FROM judged j
"""

ORACLES["op10_ngram_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split
), sizes AS (
  SELECT doc_id, len(s)::BIGINT AS n FROM sets
), entries AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, found) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.found
)
SELECT s.doc_id, s.n AS n_shingles, min(r.found) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

ORACLES["op11_secret_scan"] = r"""
WITH rules(n, kind, pattern, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 20),
  (2, 'hex', '[0-9a-f]+', 24),
  (3, 'private_key', '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----', 1),
  (4, 'host_token', 'gh[pousr]_[A-Za-z0-9]{36,}', 1),
  (5, 'chat_token', 'xox[abprs]-[A-Za-z0-9-]{10,}', 1),
  (6, 'web_token', 'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 1),
  (7, 'map_key', 'AIza[A-Za-z0-9_-]{35}', 1)
), cut AS (
  SELECT doc_id, n, kind, least, regexp_extract_all(coalesce(text, ''), pattern) AS found, string_split_regex(coalesce(text, ''), pattern) AS apart FROM documents, rules
), matches AS (
  SELECT doc_id, n, kind, least, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS k, unnest(apart[1:len(found)]) AS gap FROM cut
), placed AS (
  SELECT *, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS start FROM matches WINDOW w AS (PARTITION BY doc_id, n ORDER BY k)
), spans AS (
  SELECT doc_id, n, kind, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM placed
  WHERE CASE n WHEN 0 THEN length(regexp_extract(m, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) ELSE length(m) END >= least
), listed AS (
  SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) FILTER (n < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id
"""

ORACLES["op12_periodic_runs"] = r"""
WITH crc_steps AS (
  SELECT list(c ORDER BY n) AS steps FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))
), numbered AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM documents, crc_steps
), places AS (
  SELECT *, len(w)::BIGINT AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM numbered
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM places
), words AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, max(struct_pack(length := length, s := -start, q := -q)) AS top FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, -top.s AS start, top.length AS length, -top.q AS period, 1000 * top.length // -top.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def _rounds(n: int) -> str:
    """CTEs near<k> (part, entry and distance of every row by ``book<k>``) and book<k + 1>, for k from 0."""
    out = []
    for k in range(n + 1):
        out.append(f"""met{k} AS (
  SELECT r, p.part, entry, list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts p JOIN book{k} b ON b.part = p.part
), near{k} AS (
  SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM met{k} GROUP BY r, part
)""")
        if k < n:
            out.append(f"""sums{k} AS (
  SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS e
  FROM (SELECT part, entry, place, sum(v)::BIGINT AS total, count(*) AS n FROM (SELECT p.part, best.entry AS entry, unnest(v) AS v, unnest(range(len(v))) AS place FROM parts p JOIN near{k} USING (r, part)) GROUP BY part, entry, place) GROUP BY part, entry
), book{k + 1} AS (
  SELECT part, entry, coalesce(s.e, b.e) AS e FROM book{k} b LEFT JOIN sums{k} s USING (part, entry)
)""")
    return ",\n".join(out)


ORACLES["op13_vector_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v FROM (SELECT r, v, unnest(range(16)) AS part FROM kept)
), book0 AS (
  SELECT part, r - 1 AS entry, v AS e FROM parts WHERE r <= 64
), {_rounds(2)},
coded AS (
  SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""
