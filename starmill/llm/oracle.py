"""DuckDB twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from . import mixing

NEAR_DUPLICATES = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(words[i : i + 4], ' ')) AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 both_ AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT DISTINCT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
 least AS (SELECT a, min(b) AS component FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id"""

#: Every window of 400 bytes, those that start twice, the stretches they cover, and what is left between.
REPEATED_BYTES = """WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
 w AS MATERIALIZED (SELECT doc_id, i, md5_number(array_slice(raw, i, i + 399)) AS h FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 398)) AS i FROM d)),
 twice AS MATERIALIZED (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1),
 hit AS (SELECT doc_id, i, coalesce(CAST(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS INTEGER), 1) AS fresh FROM w SEMI JOIN twice USING (h)),
 run AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 399 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
 rest AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS p, a - 1 AS q FROM run UNION ALL SELECT doc_id, max(b) + 1, 4611686018427387904 FROM run GROUP BY 1),
 kept AS (SELECT doc_id, unhex(string_agg(hex(array_slice(raw, p, q)), '' ORDER BY p)) AS raw FROM rest JOIN d USING (doc_id) WHERE p <= q AND p <= octet_length(raw) GROUP BY 1),
 total AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY 1)
 SELECT d.doc_id, octet_length(d.raw) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN d.raw ELSE coalesce(kept.raw, ''::BLOB) END) AS kept_sha256
 FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)"""

EDITS = """WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS f, row_number() OVER w = count(*) OVER () AS last FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
 e AS (SELECT doc_id, t, length(t) AS c, f FROM n)
 SELECT doc_id, c AS n_chars, sha256(substr(t, 1, c - c // 2) || substr(f, 1, c // 2)) AS edited_sha256 FROM e"""


#: CRC-32 bit by bit, the planted periods, equal stretches of six words at every distance, their islands, and what no run repeats.
PERIODIC_RUNS = r"""WITH t AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM t),
 g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM h),
 e AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM g),
 k AS MATERIALIZED (SELECT doc_id, n, i, md5_number(array_to_string(w[i + 1:i + 6], ' ')) AS gram FROM (SELECT doc_id, n, w, unnest(range(0, n - 5)) AS i FROM e)),
 pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 2 * (b.i - a.i) <= a.n),
 island AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair) GROUP BY doc_id, q, island),
 run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
 per AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256, first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS best FROM run GROUP BY 1),
 word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM e),
 gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
 SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""

FILL_IN_MIDDLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
 u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
 c AS (SELECT *, len(unit) AS n, least(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS a, greatest(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT doc_id, n, form, text, array_to_string(unit[1:a], '') AS prefix, array_to_string(unit[a + 1:b], '') AS middle, array_to_string(unit[b + 1:n], '') AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def mixing_sql() -> str:
    """Cells, tempered marginals, every round of raking unrolled, calibration, and the draw."""
    axes = mixing.AXES
    sql = rf"""WITH w AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
 l AS MATERIALIZED (SELECT doc_id, lang, unnest(list_distinct(list_transform(list_filter(words, lambda x: length(x) >= {mixing.TOPIC_LETTERS}), lambda x: lower(x)))) AS word FROM w),
 wide AS (SELECT lang, word, count(*) AS f FROM l GROUP BY ALL),
 anchor AS MATERIALIZED (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY f DESC, word) AS place FROM wide JOIN (SELECT lang, count(*) * {mixing.TOPIC_SHARE}e0 AS most FROM w GROUP BY 1) USING (lang) WHERE f <= most QUALIFY place <= {mixing.TOPICS}),
 about AS (SELECT doc_id, max(place) AS topic FROM l JOIN anchor USING (lang, word) GROUP BY 1),
 d AS MATERIALIZED (SELECT w.doc_id, source, lang, CAST(coalesce(topic, 0) AS VARCHAR) AS topic, len(words)::BIGINT AS tokens FROM w LEFT JOIN about USING (doc_id)),
 c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL)"""
    for a in axes:
        sql += f""",
 s_{a} AS (SELECT {a}, pow(sum(CAST(tokens AS DOUBLE)), {mixing.TEMPER}e0) AS wish FROM c GROUP BY 1), to_{a} AS MATERIALIZED (SELECT {a}, wish / nullif(sum(wish) OVER (), 0) AS share FROM s_{a})"""
    sql += ",\n r0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM c)"
    steps = [a for _ in range(mixing.ROUNDS) for a in axes]
    for i, a in enumerate(steps, 1):
        sql += f", r{i} AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(weight * (share / nullif(sum(weight) OVER (PARTITION BY {a}), 0)), 0) AS weight FROM r{i - 1} JOIN to_{a} USING ({a}))"
    order = "(ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return sql + f""",
 k AS (SELECT source, lang, topic, tokens, coalesce(weight / nullif(sum(weight) OVER (), 0), 0) AS weight FROM r{len(steps)}),
 q AS (SELECT *, coalesce(weight / nullif(tokens, 0), 0) AS rate FROM k),
 b AS (SELECT *, coalesce(sum(tokens) OVER {order}, 0) AS before, 1 - coalesce(sum(weight) OVER {order}, 0) AS rest, sum(tokens) OVER () AS every FROM q),
 f AS MATERIALIZED (SELECT *, CASE WHEN rest > 1e-12 THEN greatest(every * {mixing.KEEP}e0 - before, 0) / rest END AS scale FROM b),
 j AS (SELECT scale FROM f WHERE scale * rate <= 1 ORDER BY rate DESC, source, lang, topic LIMIT 1),
 p AS (SELECT source, lang, topic, weight, CASE WHEN tokens = 0 THEN 1 ELSE least(1, coalesce((SELECT scale FROM j) * rate, 1)) END AS probability FROM f)
 SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(weight, 9) + 0e0 AS weight, round(probability, 9) + 0e0 AS probability,
  CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496e0 < probability AS sampled FROM d JOIN p USING (source, lang, topic)"""


ORACLE_SQL = {"op4_minhash_forest": NEAR_DUPLICATES, "op7_suffix_index": REPEATED_BYTES, "op8_mixing": mixing_sql(), "op12_periodic_runs": PERIODIC_RUNS, "op13_fill_in_middle": FILL_IN_MIDDLE, "check_edits": EDITS}
