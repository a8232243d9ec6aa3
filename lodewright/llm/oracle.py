"""SQL of those queries that SQL can express on whole tables."""

_CAP = r"""
WITH part AS (
  SELECT row_id, lower(regexp_replace(problem_id, '^\s+|\s+$', '', 'g')) AS problem,
         CASE WHEN score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 5 THEN score ELSE -1 END AS s
  FROM corpus WHERE problem_id IS NOT NULL AND is_correct IS DISTINCT FROM FALSE),
ranked AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY s DESC, row_id) AS rn FROM part)
"""

# Letters and digits in compatibility order. NFC stands for NFKC with case folding, which SQL does not have: they
# differ on full-width letters, ligatures and the like.
_LETTERS = r"regexp_replace(lower(nfc_normalize({})), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_BLANK = r"'^\s*$'"
_SAME = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, text, {_LETTERS.format("text")} AS k FROM documents WHERE text IS NOT NULL),
has AS (SELECT * FROM docs WHERE k <> ''),
objects AS (SELECT doc_id, TRY_CAST(text AS JSON) AS j FROM has WHERE regexp_full_match(text, '\s*\{{[\s\S]*\}}\s*')),
object_pairs AS (SELECT doc_id, unnest(json_keys(j)) AS name, j FROM objects WHERE j IS NOT NULL),
object_fields AS (SELECT doc_id, list_sort(list(concat({_LETTERS.format("name")}, '=', {_LETTERS.format("CAST(json_extract(j, concat('$.\"', name, '\"')) AS VARCHAR)")}))) AS f FROM object_pairs GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, {_BLANK})) AS l FROM has WHERE doc_id NOT IN (SELECT doc_id FROM objects)),
records AS (SELECT doc_id, l FROM lines WHERE len(l) >= 4 AND len(list_filter(l, lambda x: NOT regexp_full_match(x, '\s*[^\s:][^:]*:.*'))) = 0),
line_pairs AS (SELECT doc_id, unnest(l) AS x FROM records),
line_fields AS (SELECT doc_id, list_sort(list(concat({_LETTERS.format("split_part(x, ':', 1)")}, '=', {_LETTERS.format("substring(x, strpos(x, ':') + 1)")}))) AS f FROM line_pairs GROUP BY doc_id),
f AS (SELECT * FROM object_fields UNION ALL SELECT * FROM line_fields),
links AS (
  SELECT DISTINCT a.doc_id AS x, min(b.doc_id) AS y FROM has a JOIN has b USING (k) GROUP BY a.doc_id
  UNION SELECT DISTINCT a.doc_id, min(b.doc_id) FROM f a JOIN f b USING (f) GROUP BY a.doc_id),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM has UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
first AS (SELECT x AS doc_id, min(y) AS first_doc_id FROM reach GROUP BY x)
"""
# Jaccard similarity of all pairs of distinct texts that share a run of five characters.
_NEAR = rf"""{_SAME},
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
rep AS (SELECT min(doc_id) AS rep, t FROM t WHERE length(t) >= 5 GROUP BY t),
grams AS (SELECT rep, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) AS g FROM rep),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared s JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE s.n >= 0.7 * (x.n + y.n - s.n)),
members AS (SELECT rep, doc_id FROM rep JOIN t USING (t))
"""
_MIX = """
WITH RECURSIVE src AS (
  SELECT lower(trim(source_id)) AS source, lower(trim(domain)) AS domain, token_count AS source_tokens, lower(status) AS status FROM data_manifest WHERE source_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(source_id)) ORDER BY recorded_at DESC NULLS LAST, manifest_id DESC NULLS LAST) = 1),
adm AS (SELECT * FROM src WHERE status = 'admitted' AND source_tokens > 0),
run AS (SELECT * FROM mixture_summary WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC NULLS LAST) = 1),
want AS (
  SELECT * FROM (
    SELECT run_id, CASE WHEN max_repeats > 0 THEN max_repeats ELSE 4 END AS cap, unnest(['python', 'math', 'stem']) AS domain, unnest([target_10m.python, target_10m.math, target_10m.stem]) AS wanted FROM run)
  WHERE wanted > 0),
held AS (SELECT domain, sum(source_tokens) AS held FROM adm GROUP BY domain),
scaled AS (SELECT w.*, h.held, least(1.0, min(cap * held / wanted) OVER (PARTITION BY run_id)) AS scale FROM want w LEFT JOIN held h USING (domain)),
each AS (SELECT run_id, domain, cap, CAST(wanted AS DOUBLE) AS wanted, coalesce(CAST(wanted * scale AS DOUBLE), 0) * CAST(held IS NOT NULL AS INT) AS planned, coalesce(wanted * scale / held, 0.0) AS rate FROM scaled),
-- The mean of a Poisson count cut off at cap is cap less the sum of (cap - i) P(i); it is inverted by bisection.
bis AS (
  SELECT run_id, domain, cap, rate, CAST(0 AS DOUBLE) AS low, CAST(400 AS DOUBLE) AS high, 0 AS step FROM each WHERE rate > 0 AND rate < cap
  UNION ALL
  SELECT run_id, domain, cap, rate, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END, step + 1 FROM (
    SELECT *, (low + high) / 2 AS mid, cap - list_sum(list_transform(range(cap), lambda i: (cap - i) * exp(-(low + high) / 2) * pow((low + high) / 2, i) / factorial(CAST(i AS INTEGER)))) < rate AS below FROM bis WHERE step < 100)),
steps AS (
  SELECT run_id, domain, list_transform(range(cap), lambda j: list_sum(list_transform(range(j + 1), lambda i: exp(-high) * pow(high, i) / factorial(CAST(i AS INTEGER))))) AS steps FROM bis WHERE step = 100
  UNION ALL SELECT run_id, domain, list_transform(range(cap), lambda j: CASE WHEN rate >= cap THEN 0.0 ELSE 1.0 END) FROM each WHERE rate <= 0 OR rate >= cap),
rates AS (SELECT e.*, s.steps, a.source, a.source_tokens FROM each e JOIN steps s USING (run_id, domain) LEFT JOIN adm a USING (domain)),
docs AS (SELECT doc_id, lower(trim(source)) AS source, coalesce(octet_length(encode(text)), 0) AS size FROM documents),
drawn AS (
  SELECT r.run_id, d.doc_id, d.source, r.domain, d.size, len(list_filter(r.steps, lambda c: c <= ('0x' || substring(md5(concat('42:', r.run_id, ':', d.doc_id)), 1, 13))::BIGINT / 4503599627370496.0)) AS k
  FROM docs d JOIN rates r USING (source))
"""

ORACLE = {
    "p3_found": _CAP + "SELECT row_id FROM ranked WHERE rn > 8",
    "p3_contributors": _CAP + "SELECT problem, count(*) AS n_rows, count(*) FILTER (WHERE rn <= 8) AS n_kept FROM ranked GROUP BY problem",
    "p2_found": _NEAR + """SELECT DISTINCT least(x.doc_id, y.doc_id) AS doc_id_a, greatest(x.doc_id, y.doc_id) AS doc_id_b
      FROM pairs p JOIN members x ON x.rep = p.a JOIN members y ON y.rep = p.b JOIN first fx ON fx.doc_id = x.doc_id JOIN first fy ON fy.doc_id = y.doc_id WHERE fx.first_doc_id <> fy.first_doc_id""",
    "p2_groups": _NEAR + """, sides AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), links2 AS (SELECT x, count(*) AS n_links FROM sides GROUP BY x),
      comp AS (SELECT rep AS x, rep AS y FROM rep UNION SELECT c.x, e.y FROM comp c JOIN sides e ON c.y = e.x), root AS (SELECT x AS rep, min(y) AS class_id FROM comp GROUP BY x)
      SELECT m.doc_id, r.class_id, coalesce(l.n_links, 0) AS n_links FROM members m JOIN root r USING (rep) LEFT JOIN links2 l ON l.x = m.rep""",
    "p4_mixture": _MIX + """, c AS (SELECT run_id, doc_id, source, domain, unnest(range(1, k + 1)) AS copy, size FROM drawn WHERE k > 0)
      SELECT run_id, doc_id, source, domain, CAST(copy AS INTEGER) AS copy, size, ('0x' || substring(md5(concat('43:', run_id, ':', doc_id, ':', copy)), 1, 13))::BIGINT AS place FROM c""",
    "p4_shares": _MIX + """, s AS (SELECT run_id, source, sum(k * size) AS drawn FROM drawn GROUP BY run_id, source), b AS (SELECT source, sum(size) AS base FROM docs GROUP BY source),
      per AS (SELECT r.*, coalesce(s.drawn, 0) AS drawn, CASE WHEN b.base > 0 THEN coalesce(s.drawn, 0) / b.base ELSE 0.0 END AS passes FROM rates r LEFT JOIN s USING (run_id, source) LEFT JOIN b USING (source)),
      dom AS (SELECT run_id, domain, any_value(wanted) AS wanted_tokens, any_value(planned) AS planned_tokens, sum(passes * coalesce(source_tokens, 0)) AS reached, sum(drawn) AS drawn_bytes, any_value(rate) AS rate,
        max(passes) AS most_passes, any_value(cap) AS max_repeats FROM per GROUP BY run_id, domain),
      act AS (SELECT run_id, unnest(['python', 'math', 'stem']) AS domain, unnest([actual.python, actual.math, actual.stem]) AS actual_tokens FROM run)
      SELECT run_id, domain, max_repeats, round(rate, 6) AS rate, round(most_passes, 6) AS most_passes, wanted_tokens, round(planned_tokens, 3) AS planned_tokens, round(reached, 1) AS reached_tokens, CAST(drawn_bytes AS BIGINT) AS drawn_bytes, actual_tokens,
        round(wanted_tokens / nullif(sum(wanted_tokens) OVER w, 0), 6) AS wanted_share, round(reached / nullif(sum(reached) OVER w, 0), 6) AS reached_share,
        round(drawn_bytes / nullif(sum(drawn_bytes) OVER w, 0), 6) AS drawn_share, round(actual_tokens / nullif(sum(actual_tokens) OVER w, 0), 6) AS actual_share
      FROM dom LEFT JOIN act USING (run_id, domain) WINDOW w AS (PARTITION BY run_id)""",
    "p5_found": _SAME + "SELECT first_doc_id, doc_id FROM first WHERE first_doc_id <> doc_id",
    "p5_texts": _SAME + "SELECT first_doc_id, count(*) AS copies FROM first GROUP BY first_doc_id UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM has)",
    "p5_collisions": _SAME + "SELECT (SELECT count(DISTINCT k) FROM has) AS n_texts, 0 AS n_text_collisions, (SELECT count(DISTINCT f) FROM f) AS n_fields, 0 AS n_field_collisions",
}
