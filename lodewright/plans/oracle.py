"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from lodewright.tokenizer import corpus
from lodewright.tokenizer.study import FROZEN_LINES, frozen_vocabulary

# SQL has no Python parser. Expected values: the files (first digits of their sha256) of scales 0.001 and 0.01 that the
# interpreter's own parser rejects. On other tables the queries that use them have no SQL.
_INVALID = (
    "00e623a960", "040059ef48", "044700dfbf", "04d5a0dd3a", "05859d5677", "061f7b8274", "06550a6ebd", "0789461006", "079c4e819e", "07a4206a23", "0a0825814f", "0a31f2956c",
    "0bdab8fbd8", "0c0e6c9339", "0c22b359e5", "0f3e54e4b7", "11b088ce3e", "1223d24614", "1375c9149d", "14ddd73595", "159d9db021", "15f083c176", "169a2f4298", "19307b45e4",
    "19fc5bce2b", "1a9af22e2e", "1aa4c79c44", "1e307dcf49", "219ba863c9", "25e85c27bd", "25ff295570", "2641b49624", "26b7b8673f", "26cfaaebf8", "288654809f", "28cdab50d6",
    "2ab2afb12a", "2da9d68b63", "2ddbd60500", "2f1057bb23", "3270968ed5", "334e3cc02b", "33e0475df4", "345a4c397e", "355a2022bc", "3a13261fd0", "3b29be986c", "3b4774e50a",
    "3bc20f9eb3", "3fbcb0ca47", "41e7e76179", "43ad387bf5", "462c4a3094", "475ef4073c", "47ddb2ce6e", "4b49bf36b2", "4bde05df29", "5142f7e244", "51e01df93e", "52cfe7eb0d",
    "556f7714e7", "56a5ee56f8", "58fbeb2605", "5b9c859003", "5c311804a9", "5de96ba330", "5e3d09d869", "5e5118b2b8", "60ab828612", "62cb2a503f", "63c791bd22", "666362f93c",
    "667f7a0290", "67e91276fc", "680684ba59", "68834cdd33", "697e74e1cd", "6aabd938ef", "6ab747240f", "6bf02e8618", "6ca37836ae", "6cc5b34429", "6df7340dcf", "7078644203",
    "7364c17563", "76523dfde1", "78cdadc0f8", "7cf91c616f", "7e0d45cc42", "847b4774b2", "84d49dafa4", "85a2b0e476", "882137797a", "89e8f375fc", "8c8d887b80", "8ceda0311a",
    "8cee853a7c", "8ef57a13f0", "8fd01f47b2", "91ed2fb966", "9250c204a6", "93bcfd0708", "977ba96671", "9797a6a07c", "99221a6ef7", "9a3aa39bd7", "9bd5805e3c", "9c39b3efd5",
    "9ce95f4fe6", "9da6f8ca13", "9dc628840e", "9ebfd1d8aa", "9f67faab06", "a04f21bddb", "a08958476e", "a18ee658c2", "a2456c682b", "a4f6935635", "a534333e1e", "a6428bded2",
    "a6ab77b912", "a702eece7b", "aa136af550", "aa8aeba8f1", "aa9639b048", "ae0a9f0d78", "b0d1e98e6f", "b31f5f935d", "b606a925b6", "b64ecb2b7a", "b6d604ba68", "b9e31166d8",
    "ba7a4292ef", "bc40d1cb2e", "bcec998792", "bcf3b05020", "bd331ab126", "bf3d8b8583", "c23c8effd4", "c2c660bf66", "c51f1e80f5", "c6699d7480", "c715946973", "c83e205c20",
    "c8e4973be4", "c9791024a5", "ca8380bb24", "cba65a7e11", "cbf90d4835", "cd3dfe474e", "cd7d0ce518", "cd7d29f7d1", "cee4a8b08e", "d1da2ecad0", "d367797b5e", "d3b4b5cabf",
    "d45d445790", "d60bc16ad8", "d72a564888", "d75043afbd", "da566d72a9", "daa327802a", "dc03ff3268", "df50e8ce3e", "e1af96c6c7", "e3097452e1", "e5c9e5b0b5", "e5ed2da469",
    "e711894916", "e736b5e761", "e9c3ba2a24", "eeb0a062ce", "ef3739a5e7", "efb1c43cef", "f04063a96b", "f26b48c23f", "f3af2ddc8a", "f4067861bb", "f471e2da34", "f8ec902d06",
    "f9460a9676", "f9e7d7218e", "fa1fea405c", "faf6fae0f7", "fbb10a58d9", "fcd0beeab1", "fda9bf2d23", "ff909f63b5",
)


def _wrapped(key: str, col: str) -> str:
    """sha256 of a text wrapped in JSON, all but printable ASCII escaped."""
    return rf"""CASE WHEN {col} IS NOT NULL THEN sha256(concat('{{"{key}": "', array_to_string(list_transform(regexp_extract_all({col}, '(?s).'), lambda c: CASE
      WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'
      WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c))
      ELSE printf('\u%04x\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), ''), '"}}')) END"""


def _valid(col: str) -> str:
    return f"substring(sha256({col}), 1, 10) NOT IN ({', '.join(repr(x) for x in _INVALID)})"


# The pipeline's view of the documents table.
_DOCS = f"""
WITH RECURSIVE docs AS (
  SELECT concat(coalesce(source, ''), ':', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS doc_id, source AS source_id, doc_id AS ord, text, {_wrapped("normalized_utf8_text", "text")} AS h, domain, quality_score,
         problem_id, is_correct, language_tag, solution, token_count
  FROM documents)
"""
# Word borders that treat accented letters as letters.
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _word(pattern: str, flags: str = "(?i)") -> str:
    return f"{flags}{_B}({pattern}){_E}"


# A term that ends in a dot has its border between the dot and a word character.
_OS_IO = _word(r"subprocess|os\.system|docker|paramiko|scrapy|BeautifulSoup|socket\.socket|powershell") + r"|(?i)" + _B + r"(flask\.|django\.)[\p{L}\p{N}_]"
_CONTROL = _word("if|for|while|elif|else|try|except|return", "")
_CP_IO = _B + r"(input\s*\(|sys\.stdin|print\s*\()"
_UTILITY = _word(r"pathlib|os\.path|os\.remove|shutil|urllib|BeautifulSoup|selenium|flask|django|tkinter|pygame|argparse|subprocess|socket\.socket") + r"|(?i)" + _B + r"requests\.[\p{L}\p{N}_]"
_ALGO = _word("sort|search|graph|dfs|bfs|dp|dynamic programming|greedy|tree|hash|algorithm|complexity|theorem|proof|integral|derivative|matrix|numerical")
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"


def _has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_T = "coalesce(text, '')"
_CODES = f"""array_to_string(list_filter([
  CASE WHEN length({_T}) < 32 THEN 'too_short' END, CASE WHEN length({_T}) > 200000 THEN 'too_long' END, CASE WHEN quality_score < 2.0 THEN 'low_edu_score' END,
  CASE WHEN source_id = 'openmathinstruct_2' AND length(coalesce(solution, '')) < 20 THEN 'openmath_trivial' END, CASE WHEN NOT is_correct THEN 'incorrect_solution' END,
  CASE WHEN domain = 'python' AND language_tag <> '' AND lower(language_tag) NOT IN ('python', 'python3', 'py') THEN 'not_python' END,
  CASE WHEN {_has(_T, r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]")} THEN 'non_english' END,
  CASE WHEN domain = 'python' AND {_has(_T, _OS_IO)} THEN 'os_io_boilerplate' END], lambda x: x IS NOT NULL), ';')"""

_CODE = f"coalesce(nullif(solution, ''), {_T})"
_BROKEN = f"(coalesce(domain = 'python', false) AND NOT {_valid(_CODE)})"
_CODES_WHOLE = _CODES.replace("CASE WHEN source_id = 'openmathinstruct_2'", f"CASE WHEN {_BROKEN} THEN 'syntax_invalid' END, CASE WHEN source_id = 'openmathinstruct_2'")
_SIGNAL = f"""{_DOCS}, f AS (
  SELECT ord, domain = 'python' AS py,
    coalesce(domain = 'python', false) AND {_has(_T, r"(?i)(#include\s*<|using namespace|public static void main|fn main\s*\(|func main\s*\(|package main($|[^\p{L}\p{N}_])|defexn($|[^\p{L}\p{N}_]))")} AS o,
    {_has(_T, "(?i)(how to use|this chapter|pip install|getting started with|in this tutorial)")} AS t,
    ({_has(_T, _UTILITY)} OR {_has(_T, _B + r"open\s*\(")}) AND NOT {_has(_T, _CP_IO)} AS u,
    coalesce(domain = 'python', false) AND {_has(_CODE, _CP_IO)} AS c,
    coalesce(domain = 'python', false) AND NOT {_has(_CODE, _CP_IO)}
      AND len(list_filter(regexp_split_to_array({_CODE}, '\\r\\n|[{_ENDS}]'), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '')) <= 4
      AND NOT {_has(_CODE, _CONTROL)} AND NOT (coalesce(problem_id <> '', false) OR contains(lower({_T}), 'problem')) AS r,
    coalesce(domain = 'math', false) AND length(coalesce(solution, '')) < 20 AS m,
    coalesce(domain = 'math', false) AND length(coalesce(solution, '')) >= 20 AND ({_has(_T, r"(?i)(\\frac|\\sum|\\int|prove that|q\.e\.d|therefore)")} OR length(coalesce(solution, '')) >= 40) AS s,
    coalesce(domain = 'stem', false) AND NOT ({_has(_T, _ALGO)} OR {_has(_T, r"(?i)(\\frac|\\sum|\\int|prove that|q\.e\.d|therefore)")}) AS d
  FROM docs),
sc AS (SELECT *, CASE WHEN t OR u THEN 0.0 ELSE 4.0 END AS s1 FROM f),
sd AS (SELECT *, CASE WHEN c THEN 4.0 WHEN r THEN least(s1, 1.0) ELSE s1 END AS s2 FROM sc),
se AS (SELECT *, CASE WHEN m THEN least(s2, 1.0) WHEN s THEN 4.0 WHEN d THEN least(s2, 1.0) ELSE s2 END AS s3 FROM sd)
SELECT ord, CAST(CASE WHEN o THEN 0.0 ELSE s3 END AS DOUBLE) AS highsignal_score,
  CASE WHEN o THEN 'other_language' ELSE array_to_string(list_filter([CASE WHEN t THEN 'library_tutorial' END, CASE WHEN u THEN 'utility_io' END, CASE WHEN c THEN 'cp_stdin_stdout_keep' END,
    CASE WHEN r THEN 'trivial' END, CASE WHEN m THEN 'math_thin' END, CASE WHEN d THEN 'stem_not_reasoning_dense' END], lambda x: x IS NOT NULL), ';') END AS codes,
  (CASE WHEN o THEN 0.0 ELSE s3 END) + 1e-9 >= 3.0 AND NOT o AND NOT t AND NOT u AS accept
FROM se"""

_SIGNAL_WHOLE = (
    _SIGNAL.replace("AS d\n  FROM docs)", f"AS d,\n    {_BROKEN} AS b, doc_id\n  FROM docs)")
    .replace("CASE WHEN c THEN 4.0 WHEN r THEN least(s1, 1.0)", "CASE WHEN b THEN 1.0 * least(CASE WHEN c THEN 4.0 ELSE s1 END, 1.0) WHEN c THEN 4.0 WHEN r THEN least(s1, 1.0)")
    .replace("CASE WHEN m THEN 'math_thin' END", "CASE WHEN b THEN 'unparseable_for_signal' END, CASE WHEN m THEN 'math_thin' END")
    .replace("SELECT ord, CAST(CASE WHEN o", "SELECT doc_id, ord, CAST(CASE WHEN o")
)
# MinHash signatures of texts ``s(id, text)``: the definition, with 128-bit arithmetic.
_LITTLE = "CAST(concat('0x', substring({0}, {1} + 14, 2), substring({0}, {1} + 12, 2), substring({0}, {1} + 10, 2), substring({0}, {1} + 8, 2), substring({0}, {1} + 6, 2), substring({0}, {1} + 4, 2), substring({0}, {1} + 2, 2), substring({0}, {1}, 2)) AS UBIGINT)"
_M = "4294967295::UBIGINT"
_MINHASH = f"""perm AS (SELECT i, add & {_M} AS al, add >> 32 AS ah, mul & {_M} AS ml, mul >> 32 AS mh FROM (
  SELECT i, {_LITTLE.format("h", 1)} AS add, {_LITTLE.format("h", 17)} | 1::UBIGINT AS mul FROM (SELECT i, sha256(concat('mh:', i)) AS h FROM range(128) AS t(i)))),
-- in pieces that overlap, as a place in a long text is found by counting
part AS (SELECT id, substring(text, at0, 204) AS x FROM (SELECT id, text, unnest(range(1, length(text) + 1, 200)) AS at0 FROM s WHERE length(text) >= 5)),
grams AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(list_transform(range(1, length(x) - 3), lambda i: substring(x, i, 5))) AS g FROM part WHERE length(x) >= 5 UNION ALL SELECT id, text FROM s WHERE length(text) BETWEEN 1 AND 4)),
base AS (SELECT g, v & {_M} AS vl, v >> 32 AS vh FROM (SELECT g, {_LITTLE.format("h", 1)} AS v FROM (SELECT g, sha256(g) AS h FROM (SELECT DISTINCT g FROM grams)))),
-- v * mul + add modulo 2**64, in halves of 32 bits
prod AS (SELECT id, i, vl * ml AS low, ((vh * ml) & {_M}) + ((vl * mh) & {_M}) AS mid, al, ah FROM grams JOIN base USING (g) CROSS JOIN perm),
sums AS (SELECT id, i, (low & {_M}) + al AS lo, mid + (low >> 32) + ah AS hi FROM prod),
mins AS (SELECT id, i, min(((hi + (lo >> 32)) & {_M}) * 4294967296::UBIGINT + (lo & {_M})) AS m FROM sums GROUP BY id, i),
sigs AS (SELECT id, list(CAST(CASE WHEN m >= 9223372036854775808::UBIGINT THEN CAST(m AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(m AS HUGEINT) END AS BIGINT) ORDER BY i) AS sig FROM mins GROUP BY id
  UNION ALL SELECT id, list_transform(range(128), lambda i: CAST(0 AS BIGINT)) FROM s WHERE text = '')"""
# Pairs of documents ``x`` (later) and ``y`` of estimated similarity of at least 0.8 that share a band, and the first of those.
_SIMILAR = """same AS (
  SELECT a.id AS x, b.id AS y, list_transform(range(1, 129), lambda i: a.sig[i] = b.sig[i]) AS eq FROM (
    SELECT DISTINCT a.id AS x, b.id AS y FROM banded a JOIN banded b ON a.band = b.band AND a.key = b.key AND b.rank < a.rank) p JOIN ranked a ON a.id = p.x JOIN ranked b ON b.id = p.y),
near AS (SELECT x, y, len(list_filter(eq, lambda e: e)) / 128 AS similarity, list_filter(range(32), lambda k: eq[4 * k + 1] AND eq[4 * k + 2] AND eq[4 * k + 3] AND eq[4 * k + 4])[1] AS band FROM same),
edges AS (SELECT x, y, band, similarity FROM near WHERE similarity >= 0.8)"""
_RANKED = """ranked AS (SELECT k.doc_id AS id, source_id, sig, row_number() OVER (ORDER BY source_id NULLS FIRST, k.doc_id) AS rank FROM sigs JOIN {alive} k ON k.doc_id = sigs.id{firsts}),
banded AS (SELECT id, rank, unnest(range(32)) AS band, unnest(list_transform(range(32), lambda k: sig[4 * k + 1:4 * k + 4])) AS key FROM ranked)"""
_EXACT = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ord) AS rn FROM docs) WHERE h IS NULL OR rn = 1)"
# The greedy rule: in order, a document goes if an earlier neighbour has not gone.
_GREEDY = """cand AS (SELECT x, list(y) AS nb, row_number() OVER (ORDER BY any_value(r.rank)) AS k FROM edges JOIN ranked r ON r.id = x GROUP BY x),
fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone
  UNION ALL SELECT c.k, CASE WHEN len(list_filter(c.nb, lambda v: NOT list_contains(f.gone, v))) > 0 THEN list_append(f.gone, c.x) ELSE f.gone END FROM fold f JOIN cand c ON c.k = f.k + 1),
near_gone AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM fold ORDER BY k DESC LIMIT 1))"""
_NEAR = f"{_DOCS}, {_EXACT}, s AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM kept), {_MINHASH}"
_ALIVE = {"ingest": "d0", "problem_cap": "a1", "exact_dedup": "a2", "near_dedup": "kept", "quality": "a4", "contamination": "a5", "highsignal": "a6", "packing": "a7", "": "a7"}


def _funnel() -> str:
    """All stages one after the other; python documents are contest documents."""
    names = list(_ALIVE)
    rows = " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS step, '{s}' AS stage, (SELECT count(*) FROM {_ALIVE[s]}) AS n_in, (SELECT count(*) FROM {_ALIVE[s]}) - (SELECT count(*) FROM {_ALIVE[names[k + 1]]}) AS n_removed, (SELECT count(*) FROM {_ALIVE[names[k + 1]]}) AS n_kept"
        for k, s in enumerate(names[:-1])
    )
    return f"""{_DOCS}, d0 AS (SELECT * REPLACE (CASE WHEN domain = 'python' THEN 'codecontests_plus' ELSE source_id END AS source_id) FROM docs),
    a0 AS (SELECT *, coalesce(source_id = 'codecontests_plus', false) AS contest FROM d0),
    a1 AS (SELECT * FROM a0 WHERE NOT (contest AND (coalesce(NOT is_correct, false) OR lower(coalesce(nullif(language_tag, ''), 'python')) NOT IN ('python', 'python3', 'py')))),
    a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contest, problem_id ORDER BY h NULLS FIRST, ord) AS rn FROM a1) WHERE NOT contest OR coalesce(problem_id, '') = '' OR rn <= 8),
    firsts AS (SELECT problem_id, min(ord) AS first_ord FROM a2 WHERE contest AND problem_id <> '' GROUP BY problem_id),
    placed AS (
      SELECT a2.*, source_id = 'codecontests_plus' AS c, contest AND first_ord IS NOT NULL AS p, CASE WHEN contest THEN coalesce(first_ord, 0) ELSE 0 END AS f, CASE WHEN contest AND first_ord IS NOT NULL THEN h ELSE '' END AS hh
      FROM a2 LEFT JOIN firsts USING (problem_id)),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c NULLS FIRST, p NULLS FIRST, f, hh NULLS FIRST, ord) AS place FROM placed) WHERE h IS NULL OR place = 1),
    s AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM kept), {_MINHASH}, {_RANKED.format(alive="kept", firsts="")}, {_SIMILAR}, {_GREEDY},
    a4 AS (SELECT * FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM near_gone)),
    a5 AS (SELECT * FROM a4 WHERE {_CODES_WHOLE} = ''),
    a6 AS (SELECT * FROM a5 WHERE ord NOT IN (SELECT doc_id FROM ({_HITS} SELECT doc_id FROM best WHERE rn = 1))),
    a7 AS (SELECT * FROM a6 WHERE doc_id IN (SELECT doc_id FROM ({_SIGNAL_WHOLE}) WHERE accept))
    {rows}"""


# Greedy longest match over bytes: at each byte the longest piece, then the bytes reached from the first one, by doubling of steps.
_DOUBLINGS = 17


def _pieces() -> str:
    """The vocabulary's usable pieces as hex with their ids, from the trained vocabulary."""
    return ", ".join(f"('{t.encode('latin-1').hex().upper()}', {i})" for t, i in frozen_vocabulary()._usable().items())


def _encoded() -> str:
    """``enc``: document, token_ids with an end mark (3)."""
    steps = "".join(
        f""", j{k + 1} AS MATERIALIZED (SELECT a.doc_id, a.p, b.q FROM j{k} a JOIN j{k} b ON b.doc_id = a.doc_id AND b.p = a.q),
      r{k + 1} AS MATERIALIZED (SELECT doc_id, p FROM r{k} UNION SELECT r.doc_id, j.q FROM r{k} r JOIN j{k} j USING (doc_id, p))"""
        for k in range(_DOUBLINGS)
    )
    return f"""
    WITH piece AS (SELECT hex, id, length(hex) AS n FROM (VALUES {_pieces()}) AS t(hex, id)),
    raw AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text <> ''),
    part AS (SELECT doc_id, c, substring(x, 512 * c + 1, 600) AS x FROM (SELECT doc_id, x, unnest(range(0, (length(x) + 511) // 512)) AS c FROM raw)),
    spot AS (SELECT doc_id, 256 * c + i AS p, substring(x, 2 * i + 1, 80) AS x FROM (SELECT doc_id, c, x, unnest(range(0, least(256, length(x) // 2))) AS i FROM part)),
    cut AS MATERIALIZED (SELECT doc_id, p, n, substring(x, 1, n) AS hex FROM spot CROSS JOIN (SELECT DISTINCT n FROM piece)),
    best AS MATERIALIZED (SELECT doc_id, p, max(cut.n) AS n, arg_max(id, cut.n) AS id FROM cut JOIN (SELECT hex, id FROM piece) USING (hex) GROUP BY doc_id, p),
    j0 AS MATERIALIZED (SELECT doc_id, p, p + n // 2 AS q FROM best), r0 AS (SELECT doc_id, CAST(0 AS BIGINT) AS p FROM raw){steps},
    enc AS MATERIALIZED (
      SELECT d.doc_id, list_append(coalesce(e.ids, []), 3) AS token_ids FROM documents d
      LEFT JOIN (SELECT doc_id, list(id ORDER BY p) AS ids FROM r{_DOUBLINGS} JOIN best USING (doc_id, p) GROUP BY doc_id) e USING (doc_id))"""


_PACKED = """, ends AS (SELECT doc_id, CASE WHEN len(token_ids) > 4096 THEN list_append(token_ids[1:4095], 3) ELSE token_ids END AS ids, row_number() OVER (ORDER BY doc_id) AS k FROM enc),
    fold AS (
      SELECT k, doc_id, len(ids) AS n, CAST(0 AS BIGINT) AS seq_id, CAST(0 AS BIGINT) AS off FROM ends WHERE k = 1
      UNION ALL SELECT l.k, l.doc_id, len(l.ids), CASE WHEN f.off + f.n + len(l.ids) > 4096 THEN f.seq_id + 1 ELSE f.seq_id END, CASE WHEN f.off + f.n + len(l.ids) > 4096 THEN 0 ELSE f.off + f.n END
      FROM fold f JOIN (SELECT k, doc_id, ids FROM ends) l ON l.k = f.k + 1),
    seqs AS (SELECT seq_id, flatten(list(ids ORDER BY k)) AS ids FROM fold JOIN ends USING (k, doc_id) GROUP BY seq_id),
    packed AS (SELECT seq_id, list_concat(ids, list_transform(range(4096 - len(ids)), lambda i: 0)) AS token_ids FROM seqs)"""

_TOKENS = f"list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')"
_GRAMS = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 12 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')) END"""
_WINDOWS = """CASE WHEN length(text) = 0 THEN [] WHEN length(text) < 50 THEN [text] ELSE list_transform(range(1, length(text) - 48), lambda i: substring(text, i, 50)) END"""
_HITS = f"""
WITH dw AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL), bw AS (SELECT item_id, text, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL),
refs AS (
  SELECT 0 AS kind, g, min(item_id) AS item_id FROM (SELECT item_id, unnest({_GRAMS}) AS g FROM bw) GROUP BY g
  UNION ALL SELECT 1, g, min(item_id) FROM (SELECT item_id, unnest({_WINDOWS}) AS g FROM bw) GROUP BY g),
grams AS (SELECT doc_id, 0 AS kind, unnest({_GRAMS}) AS g FROM dw UNION ALL SELECT doc_id, 1, unnest({_WINDOWS}) FROM dw),
hit AS (SELECT DISTINCT doc_id, kind, item_id FROM grams JOIN refs USING (kind, g)),
best AS (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind, item_id) AS rn FROM hit)
"""
_PLACED = """
WITH RECURSIVE lens AS (
  SELECT doc_id, least(octet_length(encode(text)) + 1, 4096) AS n, octet_length(encode(text)) + 1 > 4096 AS truncated, row_number() OVER (ORDER BY doc_id) AS k
  FROM documents WHERE text <> ''),
fold AS (
  SELECT k, doc_id, n, truncated, CAST(0 AS BIGINT) AS seq_id, CAST(0 AS BIGINT) AS off FROM lens WHERE k = 1
  UNION ALL
  SELECT l.k, l.doc_id, l.n, l.truncated, CASE WHEN f.off + f.n + l.n > 4096 THEN f.seq_id + 1 ELSE f.seq_id END, CASE WHEN f.off + f.n + l.n > 4096 THEN 0 ELSE f.off + f.n END
  FROM fold f JOIN lens l ON l.k = f.k + 1)
"""
_LINES = f"SELECT unnest(regexp_extract_all(generated_solution, '[^{_ENDS}]*(?:\\r\\n|[{_ENDS}])|[^{_ENDS}]+')) AS line FROM corpus WHERE generated_solution IS NOT NULL"
_PAIRS = f"""
WITH l AS (SELECT line, count(*) AS n FROM ({_LINES}) WHERE line <> '' GROUP BY line), h AS (SELECT hex(encode(line)) AS x, n FROM l),
p AS (SELECT x, n, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 1)) AS i FROM h WHERE length(x) > 2)
SELECT CAST(('0x' || substring(x, 2 * i + 1, 2)) AS INTEGER) + 4 AS left, CAST(('0x' || substring(x, 2 * i + 3, 2)) AS INTEGER) + 4 AS right, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2
"""
_SUBS = "SELECT raw_id, id, coalesce(title, '') AS title, coalesce(description, '') AS description, {list} AS subs FROM raw_contests WHERE correct_submissions IS NOT NULL"
_PY3 = "replace(lower(s.language), ' ', '') IN ('py3', 'python3', 'python')"
_PID = "coalesce(nullif(id, ''), nullif(title, ''), '')"
_KNOWN = "(VALUES ('python', 7690000), ('math', 1540000), ('stem', 770000)) AS k(domain, target)"
_REQUIRED = ("source_id", "url", "license", "provenance", "collection_date", "language", "domain", "quality_score", "contamination_risk", "raw_hash", "normalized_hash", "token_count")
_MISSING = ", ".join(f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in _REQUIRED)
_ALLOWED = "'apache-2.0', 'mit', 'bsd-2-clause', 'bsd-3-clause', 'cc-by-4.0', 'cc-by-sa-4.0', 'odc-by-1.0'"



def _synthetic() -> str:
    """The training texts: the fixed ones as they are, the others from their rule."""
    quoted = lambda t: "chr(0)".join("concat('" + x.replace("'", "''") + "')" for x in [t]) if "\0" not in t else "concat(" + ", chr(0), ".join("'" + x.replace("'", "''") + "'" for x in t.split("\0")) + ")"
    fixed = ", ".join(f"({k}, {quoted(t)})" for k, t in enumerate(corpus.EVALUATION.values()))
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    n = len(corpus.EVALUATION)
    return f"""WITH i AS (SELECT i FROM range({FROZEN_LINES}) AS t(i)), w AS (
        SELECT i, concat('x_', i % 17) AS x, {words(corpus.LINE_KEYWORDS)}[i % 10 + 1] AS word, {words(corpus.LINE_STEMS)}[i % 10 + 1] AS stem FROM i)
      SELECT CAST(ord AS INTEGER) AS ord, text FROM (VALUES {fixed}) AS f(ord, text)
      UNION ALL SELECT CAST({n} + i AS INTEGER), concat(
        word, ' ', stem, '_', i, '_value(', x, ': float) -> float:', chr(10), '    y = ', x, ' * ', i % 997 + 1, '.', 7 * i % 1000, 'e', i % 9 - 4, ' + ', i % 13, chr(10), '    if y == 0 or y != y:', chr(10),
        '        return 0.0', chr(10), '    return y ** 2 // 1', chr(10), CASE WHEN i % 11 = 0 THEN concat('    # unit: kg m / s^2  λ=', i, '  Δ=', i % 5, chr(10)) ELSE '' END,
        CASE WHEN i % 19 = 0 THEN concat('from typing import Optional, Sequence', chr(10), 'import math', chr(10)) ELSE '' END) FROM w"""


ORACLE = {
    "normalize_binary": r"""SELECT doc_id, CASE WHEN text = '' THEN false ELSE contains(text, chr(0)) OR length(regexp_replace(regexp_replace(text, '[\n\r\t ]', 'x', 'g'), '[\pC\pZ]', '', 'g')) / length(text) < 0.85 END AS is_binary FROM documents""",
    "normalize_reasons": r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'not_text' WHEN text = '' THEN NULL
      WHEN contains(text, chr(0)) OR length(regexp_replace(regexp_replace(text, '[\n\r\t ]', 'x', 'g'), '[\pC\pZ]', '', 'g')) / length(text) < 0.85 THEN 'binary' END AS reason FROM documents""",
    "content_hashes": f"SELECT doc_id, {_wrapped('raw', 'text')} AS raw_hash, {_wrapped('normalized_utf8_text', 'text')} AS normalized_hash FROM documents",
    "hash_equality": "SELECT doc_id, sha256(text) AS h FROM documents",
    "python3_tags": "SELECT language_tag, count(*) AS n, coalesce(replace(lower(language_tag), ' ', '') IN ('py3', 'python3', 'python'), false) AS is_python3 FROM corpus GROUP BY language_tag",
    "contract_missing": f"SELECT manifest_id, array_to_string(list_filter([{_MISSING}], lambda x: x IS NOT NULL), ';') AS errors FROM data_manifest",
    "license_inventory": f"""SELECT manifest_id, CASE WHEN coalesce(identity_status, '') <> 'verified' OR coalesce(license, '') = '' OR license NOT IN ({_ALLOWED}) THEN 'blocked' ELSE 'admitted' END AS status,
      CASE WHEN coalesce(identity_status, '') <> 'verified' THEN 'identity unresolved' WHEN coalesce(license, '') = '' THEN 'license unverifiable' WHEN license NOT IN ({_ALLOWED}) THEN concat('license not on allowlist: ', license) END AS block_reason
      FROM data_manifest""",
    "inventory_backfill": """SELECT m.source_id, CAST(coalesce(sum(d.token_count), 0) AS BIGINT) AS token_count, count(d.doc_id) AS fetch_rows FROM (SELECT DISTINCT source_id FROM data_manifest WHERE source_id IS NOT NULL) m
      LEFT JOIN documents d ON d.source = m.source_id GROUP BY m.source_id""",
    "manifest_shards": "SELECT source_id, domain, coalesce(token_count, 0) AS token_count, status FROM data_manifest",
    "ingest_filter": """SELECT row_id AS doc_id, CASE WHEN NOT is_correct THEN 'incorrect_solution' ELSE 'not_python' END AS reason FROM corpus
      WHERE problem_id IS NOT NULL AND (coalesce(NOT is_correct, false) OR lower(coalesce(nullif(language_tag, ''), 'python')) NOT IN ('python', 'python3', 'py'))""",
    "expand_contests": f"""WITH r AS ({_SUBS.format(list=f"list_filter(correct_submissions, lambda s: coalesce({_PY3}, false) AND coalesce(s.code, '') <> '')[1:8]")}),
      e AS (SELECT *, unnest(range(0, len(subs))) AS item FROM r)
      SELECT raw_id, CAST(item AS INTEGER) AS item, concat('# ', title, chr(10), '# ', {_PID}, chr(10), chr(10), description, chr(10), chr(10), '# solution', chr(10), subs[item + 1].code, chr(10)) AS text, {_PID} AS problem_id, subs[item + 1].code AS solution FROM e""",
    "expand_parallel_solutions": f"""WITH r AS ({_SUBS.format(list=f"list_filter(correct_submissions, lambda s: coalesce({_PY3}, false) AND coalesce(s.code, '') <> '')[1:8]")}),
      e AS (SELECT *, unnest(range(0, len(subs))) AS item FROM r)
      SELECT raw_id, CAST(item AS INTEGER) AS item, concat('# ', title, chr(10), '# dm:', title, chr(10), chr(10), description, chr(10), chr(10), '# solution', chr(10), subs[item + 1].code, chr(10)) AS text, concat('dm:', title) AS problem_id FROM e""",
    "expand_solution_lists": f"""WITH r AS ({_SUBS.format(list="list_filter(correct_submissions, lambda s: coalesce(s.code, '') <> '')[1:8]")}), e AS (SELECT *, unnest(range(0, len(subs))) AS item FROM r)
      SELECT raw_id, CAST(item AS INTEGER) AS item, concat(description, chr(10), chr(10), '# solution', chr(10), subs[item + 1].code, chr(10)) AS text, concat('apps:', coalesce(nullif(id, ''), '')) AS problem_id FROM e""",
    "extract_math": "SELECT row_id, concat(coalesce(problem, ''), chr(10), chr(10), generated_solution) AS text, generated_solution AS solution FROM corpus WHERE language_tag IS NULL AND generated_solution IS NOT NULL",
    "make_documents": r"""SELECT concat('web:', lpad(CAST(row_id AS VARCHAR), 6, '0'), ':00') AS doc_id, 'web' AS source_id, 'en' AS language, 'stem' AS domain, score AS quality_score, 'unchecked' AS contamination_risk, HASHED AS normalized_hash, 'candidate' AS status, text
      FROM corpus WHERE text <> '' AND NOT (contains(text, chr(0)) OR length(regexp_replace(regexp_replace(text, '[\n\r\t ]', 'x', 'g'), '[\pC\pZ]', '', 'g')) / length(text) < 0.85)""".replace("HASHED", _wrapped("normalized_utf8_text", "text")),
    "exact_dedup": _DOCS + "SELECT ord, h AS normalized_hash FROM (SELECT ord, h, row_number() OVER (PARTITION BY h ORDER BY ord) AS rn FROM docs) WHERE h IS NULL OR rn = 1",
    "exact_dup_removed": _DOCS + "SELECT doc_id, duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER w AS duplicate_of, row_number() OVER w AS rn FROM docs WHERE h IS NOT NULL WINDOW w AS (PARTITION BY h ORDER BY ord)) WHERE rn > 1",
    "minhash_signatures": f"WITH s AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_MINHASH} SELECT id AS doc_id, sig AS signature FROM sigs",
    "near_edges": f"""{_NEAR}, low AS (SELECT min(struct_pack(a := coalesce(source_id, ''), b := k.doc_id)).b AS doc_id FROM sigs JOIN kept k ON k.doc_id = id GROUP BY sig),
      {_RANKED.format(alive="kept", firsts=" WHERE k.doc_id IN (SELECT doc_id FROM low)")}, {_SIMILAR} SELECT x AS later, y AS earlier, CAST(band AS INTEGER) AS band, similarity FROM edges""",
    "near_dedup": f"""{_NEAR}, {_RANKED.format(alive="kept", firsts="")}, {_SIMILAR}, {_GREEDY}
      SELECT e.x AS doc_id, arg_min(e.y, e.band * 1000000 + r.rank) AS duplicate_of FROM edges e JOIN ranked r ON r.id = e.y WHERE e.x IN (SELECT doc_id FROM near_gone) AND e.y NOT IN (SELECT doc_id FROM near_gone) GROUP BY e.x""",
    "quality_removed": _DOCS + f"SELECT doc_id, string_split({_CODES_WHOLE}, ';') AS reason_codes FROM docs WHERE {_CODES_WHOLE} <> ''",
    "highsignal_removed": f"SELECT doc_id, CASE WHEN codes = '' THEN ['below_threshold'] ELSE string_split(codes, ';') END AS reason_codes, highsignal_score AS score FROM ({_SIGNAL_WHOLE}) WHERE NOT accept",
    "syntax_check": f"SELECT row_id, {_valid('generated_solution')} AS parses FROM corpus WHERE generated_solution IS NOT NULL AND replace(lower(language_tag), ' ', '') IN ('py3', 'python3', 'python')",
    "reason_histogram_whole": _DOCS + f"SELECT 'quality' AS stage, code, count(*) AS n FROM (SELECT unnest(string_split({_CODES_WHOLE}, ';')) AS code FROM docs) WHERE code <> '' GROUP BY code",
    "problem_cap": _DOCS + "SELECT doc_id, problem_id FROM (SELECT doc_id, problem_id, row_number() OVER (PARTITION BY problem_id ORDER BY h NULLS FIRST, ord) AS rn FROM docs WHERE problem_id <> '') WHERE rn > 8",
    "canonical_order": _DOCS + """, c AS (SELECT *, domain = 'python' AS py FROM docs), g AS (SELECT problem_id, min(ord) AS first_ord FROM c WHERE py AND problem_id <> '' GROUP BY problem_id)
      SELECT doc_id, CASE WHEN py THEN 1 ELSE 0 END AS is_contest, CASE WHEN py AND g.first_ord IS NOT NULL THEN 1 ELSE 0 END AS grouped, CASE WHEN py THEN coalesce(g.first_ord, 0) ELSE 0 END AS first_ord,
        CASE WHEN py AND g.first_ord IS NOT NULL THEN h ELSE '' END AS hash FROM c LEFT JOIN g USING (problem_id)""",
    "quality_rules": _DOCS + f"SELECT ord, {_CODES} AS codes FROM docs",
    "reason_histogram": _DOCS + f"SELECT 'quality' AS stage, code, count(*) AS n FROM (SELECT unnest(string_split({_CODES}, ';')) AS code FROM docs) WHERE code <> '' GROUP BY code",
    "highsignal_rules": _SIGNAL,
    "token_ngrams": f"SELECT doc_id, len(list_distinct({_GRAMS})) AS n_grams FROM (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL)",
    "reference_index": f"""WITH bw AS (SELECT item_id, text, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL), refs AS (
      SELECT 0 AS kind, g, min(item_id) AS item_id FROM (SELECT item_id, unnest({_GRAMS}) AS g FROM bw) GROUP BY g UNION ALL SELECT 1, g, min(item_id) FROM (SELECT item_id, unnest({_WINDOWS}) AS g FROM bw) GROUP BY g)
      SELECT kind, CAST(item_id AS VARCHAR) AS ref_id, count(*) AS n_grams FROM refs GROUP BY kind, item_id""",
    "contamination_hits": _HITS + "SELECT doc_id, CAST(item_id AS VARCHAR) AS matched_ref FROM best WHERE rn = 1",
    "contamination_report": _HITS + "SELECT (SELECT count(*) FROM benchmark) AS n_refs, count(*) AS n_hits, 0 AS n_unresolved FROM best WHERE rn = 1",
    "line_multiset": f"SELECT line, count(*) AS n FROM ({_LINES}) WHERE line <> '' GROUP BY line",
    "bpe_pair_counts": _PAIRS,
    "bpe_best_pair": f"SELECT * FROM ({_PAIRS}) ORDER BY n DESC, \"left\", \"right\" LIMIT 1",
    "tokenize_ids": _encoded() + " SELECT doc_id, token_ids FROM enc",
    "tokenize_counts": _encoded() + " SELECT doc_id, CAST(len(token_ids) - 1 AS INTEGER) AS token_count FROM enc",
    "packed_sequences": _encoded().replace("WITH piece", "WITH RECURSIVE piece", 1) + _PACKED + " SELECT seq_id, token_ids FROM packed",
    "packed_validation": _encoded().replace("WITH piece", "WITH RECURSIVE piece", 1) + _PACKED + """ SELECT min(list_min(token_ids)) AS min_id, max(list_max(token_ids)) AS max_id,
      CAST(sum(len(list_filter(token_ids, lambda x: x < 0 OR x >= 32768))) AS BIGINT) AS n_out_of_range, CAST(sum(len(list_filter(token_ids, lambda x: x <> 0))) AS BIGINT) AS non_pad_tokens FROM packed""",
    "synthetic_corpus": _synthetic(),
    "vocabulary_table": "SELECT * FROM (VALUES ('special', 4), ('byte', 256), ('piece', 1030), ('unused', 31478)) AS t(kind, n)",
    "packing_assign": _PLACED + 'SELECT doc_id, seq_id, off AS "offset", n AS n_packed, truncated FROM fold',
    "packing_stats": _PLACED + """, s AS (SELECT max(seq_id) + 1 AS q, sum(n) AS used, count(*) FILTER (WHERE truncated) AS cut FROM fold)
      SELECT q AS n_sequences, CAST(ceil(q / 245.0) AS BIGINT) AS n_shards, q * 4096 AS packed_tokens, CAST(q * 4096 - used AS BIGINT) AS pad_tokens, round((q * 4096 - used) / (q * 4096.0), 6) AS waste_ratio, cut AS truncated_docs, 4096 AS n_ctx FROM s""",
    "packing_shards": _PLACED + "SELECT CAST(seq_id // 245 AS INTEGER) AS shard_id, count(DISTINCT seq_id) AS n_sequences FROM fold GROUP BY 1",
    "holdout_split": _PLACED + """, s AS (SELECT DISTINCT seq_id FROM fold), n AS (SELECT max(seq_id) + 1 AS n FROM s)
      SELECT seq_id, CASE WHEN seq_id < greatest(1, floor(n * 0.02)) THEN 'eval' ELSE 'train' END AS split, CASE WHEN seq_id >= floor(n * 0.9) THEN 'eval' ELSE 'train' END AS tail_split FROM s, n""",
    "mixture_cap": """WITH RECURSIVE d AS (SELECT doc_id, domain, coalesce(n_chars, 0) AS n, CASE domain WHEN 'python' THEN 200000 WHEN 'math' THEN 100000 WHEN 'stem' THEN 150000 ELSE 0 END AS goal, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS k FROM documents),
      fold AS (SELECT k, doc_id, domain, goal, n <= goal AS ok, CASE WHEN n <= goal THEN n ELSE 0 END AS used FROM d WHERE k = 1
      UNION ALL SELECT d.k, d.doc_id, d.domain, d.goal, f.used + d.n <= d.goal, CASE WHEN f.used + d.n <= d.goal THEN f.used + d.n ELSE f.used END FROM fold f JOIN d ON d.domain = f.domain AND d.k = f.k + 1)
      SELECT doc_id, domain FROM fold WHERE ok""",
    "domain_tokens": f"SELECT k.domain, CAST(coalesce(sum(d.token_count), 0) AS BIGINT) AS tokens FROM {_KNOWN} LEFT JOIN documents d USING (domain) GROUP BY k.domain",
    "domain_deviation": f"""WITH t AS (SELECT k.domain, CAST(coalesce(sum(d.token_count), 0) AS BIGINT) AS tokens, any_value(k.target) AS target FROM {_KNOWN} LEFT JOIN documents d USING (domain) GROUP BY k.domain)
      SELECT domain, tokens, CAST(target AS BIGINT) AS target, CAST(tokens - target AS BIGINT) AS deviation FROM t UNION ALL SELECT 'total', CAST(sum(tokens) AS BIGINT), CAST(sum(target) AS BIGINT), CAST(sum(tokens - target) AS BIGINT) FROM t""",
    "tokens_per_source": "SELECT source AS source_id, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, count(*) AS n_docs FROM documents GROUP BY source",
    "subsource_share": """WITH p AS (SELECT domain, source AS source_id, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM documents GROUP BY domain, source)
      SELECT domain, source_id, tokens, round(CASE WHEN sum(tokens) OVER w = 0 THEN 0.0 ELSE tokens / sum(tokens) OVER w END, 6) AS share, count(*) OVER w AS n_sources FROM p WINDOW w AS (PARTITION BY domain)""",
    "share_applicability": """SELECT domain, count(*) AS available_sources, count(*) >= 3 AS applicable, CASE WHEN count(*) >= 3 THEN 'applicable' ELSE 'not_applicable' END AS status
      FROM (SELECT DISTINCT source_id, domain, status FROM data_manifest) WHERE coalesce(status, '') <> 'blocked' GROUP BY domain""",
    "blocked_sources": "SELECT DISTINCT source_id FROM data_manifest WHERE status = 'blocked'",
    "solutions_per_problem": "SELECT problem_id, count(*) AS before, count(*) FILTER (WHERE is_correct) AS after FROM corpus WHERE problem_id <> '' GROUP BY problem_id",
    "stage_funnel": _funnel(),
    "math_gap": "SELECT run_id, created_at, coalesce(math_raw_estimate_vs_plan.raw_estimate, 0) - coalesce(math_raw_estimate_vs_plan.plan_target, 0) AS gap FROM mixture_summary",
}
