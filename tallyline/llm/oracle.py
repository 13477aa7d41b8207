"""DuckDB SQL over the given tables for the queries that SQL can express."""

from __future__ import annotations

from tallyline.llm.quality_rules import COMMON_WORDS

WINDOWS = """
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM split, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, p.size, i, item_id FROM places p JOIN windows USING (size, run)),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS place FROM hits)
"""

LISTS = ", ".join(f"('{lang}', {words!r})" for lang, words in COMMON_WORDS.items())



def clustering(rounds: int = 3, clusters: int = 16) -> str:
    """Rounds of assigning vectors to centroids and moving these, one after the other."""
    nearest = """
a{n} AS (
  SELECT row, v, arg_min({{'c': c, 'd': d}}, {{'d': d, 'c': c}}) AS best
  FROM (SELECT row, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{n})
  GROUP BY row, v)"""
    moved = """
s{n} AS (
  SELECT best.c AS c, i, sum(x) AS s, count(*) AS k
  FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY ALL),
m{n} AS (SELECT c, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS w FROM s{n} GROUP BY c),
c{next} AS (SELECT c, coalesce(m.w, o.w) AS w FROM c{n} o LEFT JOIN m{n} m USING (c))"""
    parts = [
        """WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}))""",
    ]
    for n in range(rounds):
        parts += [nearest.format(n=n), moved.format(n=n, next=n + 1)]
    parts.append(nearest.format(n=rounds))
    parts.append("inertias AS (SELECT best.c AS c, sum(best.d) AS s FROM a3 GROUP BY ALL)".replace("a3", f"a{rounds}"))
    return ",".join(parts) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, s::BIGINT AS cluster_inertia,
  (SELECT sum(s) FROM inertias)::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN inertias ON best.c = inertias.c JOIN c{rounds} ON best.c = c{rounds}.c
"""


ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH {WINDOWS}
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s
LEFT JOIN (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id) USING (doc_id)
""",
    "op4_warc": """
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
led AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS leader FROM page)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM led
""",
    "op6_quality_rules": rf"""
WITH list(lang, common) AS (VALUES {LISTS}),
doc AS (
  SELECT doc_id, coalesce(l.lang, '') AS key, common, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    string_split(translate(lower(coalesce(text, '')), '.,;:!?()"' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
      repeat(' ', 14)), ' ') AS tokens
  FROM documents d LEFT JOIN list l ON d.lang = l.lang),
base AS (
  SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(regexp_extract_all(t, '\p{{L}}')) AS letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper,
    len(regexp_extract_all(t, '[0-9]')) AS digits, len(regexp_extract_all(t, '[.,;:!?''"()-]')) AS marks
  FROM doc),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS run
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM doc WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
again AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY 1),
counts AS (
  SELECT doc_id, key, 'classes' AS kind, unnest([letters - upper, upper, digits, length(t) - word_chars, marks, n_symbols,
    word_chars - letters - digits - marks - n_symbols]) AS c, unnest(generate_series(1, 7)) AS i
  FROM base WHERE length(t) >= 600
  UNION ALL
  SELECT doc_id, key, 'words', unnest(list_append(found, greatest(n_words - list_sum(found), 0))),
    unnest(generate_series(1, len(found) + 1))
  FROM (SELECT *, list_transform(common, lambda x: len(list_filter(tokens, lambda y: y = x))) AS found
    FROM base WHERE common IS NOT NULL AND n_words >= 120)),
shares AS (SELECT doc_id, key, kind, i, c / sum(c) OVER (PARTITION BY doc_id, kind) AS p FROM counts),
means AS (SELECT key, kind, i, avg(p) AS q FROM shares GROUP BY ALL),
distances AS (
  SELECT doc_id, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS distance
  FROM shares JOIN means USING (key, kind, i) GROUP BY ALL),
far AS (SELECT DISTINCT doc_id FROM distances WHERE distance > CASE kind WHEN 'classes' THEN 0.23 ELSE 0.3 END),
judged AS (
  SELECT *, coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
  FROM base LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM far) AS kept
FROM judged
""",
    "op7_line_dedup": """
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
judged AS (
  SELECT * FROM (
    SELECT doc_id, place, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+') AS w FROM line) WHERE len(w) >= 1),
firsts AS (SELECT w, min({'doc': doc_id, 'place': place}) AS spot FROM judged GROUP BY w),
variant AS (
  SELECT w, spot, i, list_concat(w[:i - 1], w[i + 1:]) AS v
  FROM (SELECT w, spot, unnest(generate_series(1, len(w))) AS i FROM firsts WHERE len(w) >= 5)),
near AS (
  SELECT w, spot FROM firsts
  UNION ALL SELECT a.w, b.spot FROM variant a JOIN variant b ON a.v = b.v AND a.i = b.i
  UNION ALL SELECT a.w, b.spot FROM variant a JOIN firsts b ON a.v = b.w WHERE len(b.w) >= 5
  UNION ALL SELECT b.w, a.spot FROM variant a JOIN firsts b ON a.v = b.w WHERE len(b.w) >= 5),
least AS (SELECT w, min(spot) AS spot FROM near GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, place FROM judged JOIN least USING (w) WHERE {'doc': doc_id, 'place': place} > spot),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS kept FROM line ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
""",
    "op8_substring_dedup": """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS run
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM split WHERE len(w) >= 50)),
firsts AS (SELECT run, min(doc_id) AS least FROM places GROUP BY run HAVING min(doc_id) < max(doc_id)),
covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS place
  FROM places JOIN firsts USING (run) WHERE least < doc_id),
gone AS (SELECT doc_id, list(place ORDER BY place) AS places, count(*) AS n FROM covered GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
  FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op13_centroid_clustering": clustering(),
}
