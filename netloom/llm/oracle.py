"""SQL, for DuckDB, of the queries that it can express."""

from __future__ import annotations

from .quality_rules import STOP_FORMS

_STOP = ", ".join(f"'{w}'" for w in STOP_FORMS)

#: Draws invert the summed Poisson probabilities at the first 52 bits of an MD5; 400 steps are enough for the rates of a test table.
MIX = """WITH d AS (SELECT *, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS identity FROM documents),
 s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
 t AS (SELECT sum(pow(size, 0.5)) AS roots, sum(size) AS total FROM s),
 r AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / roots * total / size ELSE 0 END AS rate FROM s, t),
 p AS (SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT source, rate, CAST(unnest(range(0, 400)) AS DOUBLE) AS k FROM r)),
 u AS (SELECT *, CAST('0x' || substring(md5('mix-1|' || identity), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw FROM d),
 n AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.upto <= u.draw) AS n_copies FROM u),
 c AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)
 SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, md5('mix-1|' || identity || '|' || CAST(copy AS VARCHAR)) AS mix_key FROM c"""

#: All pairs that share a window are counted, then components are walked; doc_ids are unique in the table.
NGRAM_JOIN = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS grams FROM w),
 e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
 pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
   HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
  UNION ALL SELECT a.doc_id, b.doc_id FROM g a JOIN g b ON len(a.grams) = 0 AND len(b.grams) = 0 AND a.doc_id <> b.doc_id),
 reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
 SELECT d.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links, d.doc_id = c.class_id AS kept FROM documents d
  JOIN (SELECT u, min(v) AS class_id FROM reach GROUP BY u) c ON c.u = d.doc_id LEFT JOIN (SELECT u, count(*) AS n_links FROM pairs GROUP BY u) l ON l.u = d.doc_id"""

QUALITY_RULES = f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 b AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM a),
 w AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) AS gram FROM b WHERE len(words) >= 5),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM w) WHERE n > 1),
 q AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS place FROM r) GROUP BY doc_id),
 m AS (SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
  len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop,
  len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*\u2022]'))) AS n_bullets, len(list_filter(lines, lambda x: NOT regexp_matches(x, '[^ \t-\r][ \t-\r]*[ ][ \t-\r]*[^ \t-\r]'))) AS n_one_word,
  CAST(greatest(len(lines), 10) AS DOUBLE) AS l FROM b LEFT JOIN q ON q.doc_id = b.doc_id),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS d FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / d >= 2 AND word_chars / d <= 40 AND n_symbols / d <= 0.1 AND n_marks / d <= 0.2 AND n_dup_lines / l <= 0.3
   AND n_bullets / l <= 0.9 AND n_one_word / l <= 0.8 AND (n_words < 40 OR n_stop / d >= 0.02) AS kept FROM f"""

#: Every order is applied by counting documents; sums over all orders are taken from them.
FILTER_AUDIT = """WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM t),
 f AS (SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 g AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
 n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM n p JOIN n q ON q.x <> p.x JOIN n r ON r.x NOT IN (p.x, q.x) JOIN n s ON s.x NOT IN (p.x, q.x, r.x) JOIN n u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
 k AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
 j AS (SELECT *, ascii(filter_order[step]) - 64 AS own, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier FROM k),
 m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY part, fails),
 x AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fails_it, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda i: i)) = 1 AS alone FROM m, j),
 y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (fails_it AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails_it AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails_it AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fails_it AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails_it AND NOT gone), 0) AS toxic_lost FROM x GROUP BY ALL)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM y"""


def vector_codes() -> str:
    """All rounds written out: parts of integer vectors as lists, every distance by a plain sum."""
    distance = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        """k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 v AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // 8 + 1 : (part + 1) * len(x) // 8] AS x FROM k, (SELECT unnest(range(0, 8)) AS part)),
 b0 AS MATERIALIZED (SELECT part, e, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 16) USING (vec_id))"""
    ]
    for r in range(7):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, v.label, v.part, v.x, arg_min(b.e, d * 16 + b.e) AS e, min(d) AS d FROM v JOIN b{r} b ON b.part = v.part, LATERAL (SELECT CAST({distance} AS BIGINT) AS d) GROUP BY ALL)")
        if r < 6:
            steps.append(f"m{r} AS (SELECT part, e, i, sum(y) AS total, count(*) AS n FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL)")
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.x, o.x) AS x FROM b{r} o LEFT JOIN (SELECT part, e, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY part, e) n USING (part, e))""")
    return "WITH " + ",\n ".join(steps) + """,
 h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b6),
 c AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


#: Every window of 200 bytes, as hexadecimal digits, is counted; places of those that stand twice are joined to runs.
SUFFIX_DEDUP = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
 w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200)),
 r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
 g AS (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM r)),
 s AS (SELECT doc_id, k, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY doc_id, k),
 p AS (SELECT doc_id, k, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS from_ FROM s),
 a AS (SELECT doc_id, t.n, string_agg(substring(h, 2 * from_ + 1, 2 * (b - from_)), '' ORDER BY k) AS head, sum(e - b) AS gone, count(*) AS spans, max(e) AS last FROM p JOIN t USING (doc_id) GROUP BY doc_id, t.n)
 SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN a USING (doc_id)"""
