"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from finframe.llm import chat, pii, quality

ORACLES: dict[str, str] = {}

ORACLES["op6_url_rules"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
n AS (SELECT *, row_number() OVER () AS r FROM p),
fit AS (
  SELECT n.r, arg_max(rules.host || rules.path, length(rules.host || rules.path) * 1000 + length(rules.host)) AS rule,
         arg_max(rules.verdict, length(rules.host || rules.path) * 1000 + length(rules.host)) AS verdict
  FROM n JOIN rules ON (n.host = rules.host OR ends_with(n.host, '.' || rules.host)) AND starts_with(n.path, rules.path)
  GROUP BY n.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN fit USING (r)
"""

ORACLES["op7_top_k"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op13_nearest"] = """
WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# every phrase of one to five words counted by itself
ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k)),
f AS (SELECT lang, k, ws[i:i + k - 1] AS words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= 100),
parts AS (SELECT lang, words, f AS a, cut, words[1:cut] AS head, words[cut + 1:] AS tail FROM c, range(1, 5) t(cut) WHERE cut < k),
cut AS (
  SELECT p.lang, p.words, p.a, p.cut, h.f AS l, t.f AS r, n.n, ((1000::HUGEINT * p.a * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM parts p JOIN n ON n.lang = p.lang JOIN f h ON h.lang = p.lang AND h.words = p.head JOIN f t ON t.lang = p.lang AND t.words = p.tail),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
sub AS (SELECT c.lang, c.f, words[i:i + m - 1] AS part FROM c, range(2, 5) s(m), range(1, 5) t(i) WHERE m < c.k AND i + m - 1 <= c.k),
held AS (SELECT lang, part, max(f) AS f FROM sub GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN held ON held.lang = low.lang AND held.part = low.words WHERE coalesce(held.f, 0) * 100 < 100 * a),
named AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

# sequential insertion into the ring, one key after the other
ORACLES["op1_ring_shards"] = """
WITH RECURSIVE
place AS (
  SELECT s::INTEGER AS shard, ('0x' || substr(md5('shard:' || s || ':' || n), 1, 15))::BIGINT AS at
  FROM range(8) a(s), range(64) b(n)),
k AS (SELECT doc_id, coalesce(text, '') AS t, md5('key:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
o AS (
  SELECT doc_id, t, ('0x' || substr(h, 1, 15))::BIGINT AS at, row_number() OVER (ORDER BY ('0x' || substr(h, 17, 15))::BIGINT, doc_id) AS turn FROM k),
near AS (
  SELECT o.turn, place.shard, min((place.at - o.at + 1152921504606846976) % 1152921504606846976) AS ahead
  FROM o, place GROUP BY ALL),
choice AS (SELECT turn, list(shard ORDER BY ahead) AS choices FROM near GROUP BY turn),
tab AS (
  SELECT list(v ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(n))),
crc AS (
  SELECT turn, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || b)::UBIGINT for b in regexp_extract_all(hex(encode(t)), '..')]),
                               lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM o, tab),
size AS (SELECT count(*) AS n FROM o),
walk(turn, loads, shard) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], NULL::INTEGER
  UNION ALL
  SELECT turn, [loads[i] + CASE WHEN i = pick + 1 THEN 1 ELSE 0 END for i in range(1, 9)], pick
  FROM (SELECT choice.turn, w.loads,
               [s for s in choice.choices if w.loads[s + 1] < size.n // 8 + CASE WHEN s < size.n % 8 THEN 1 ELSE 0 END][1] AS pick
        FROM walk w JOIN choice ON choice.turn = w.turn + 1 CROSS JOIN size))
SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, text_crc32, 'rows' AS law, walk.shard,
       row_number() OVER (PARTITION BY walk.shard ORDER BY turn) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN walk USING (turn) JOIN crc USING (turn)
"""

# every pair of documents that shares a shingle, and what can be reached from each
ORACLES["op3_near_duplicates"] = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END) AS g FROM w),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS c FROM edge UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.doc_id),
low AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY ALL)
SELECT doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(low.c, doc_id) AS component_id, coalesce(low.c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN low USING (doc_id)
"""

# the stated patterns as they read, places as sums of the lengths before them
_PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "secret": r"\b(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b",
}
_PII_CHECKS = {
    "email": "true", "ip": "list_max([len(ltrim(p, '0')) for p in string_split(hit, '.')]) <= 3 AND list_max([CAST(right(p, 3) AS INTEGER) for p in string_split(hit, '.')]) <= 255",
    "card": "len(digits) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INTEGER) WHEN CAST(substr(reverse(digits), i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) END for i in range(1, len(digits) + 1)]) % 10 = 0",
    "phone": "len(digits) BETWEEN 9 AND 15",
    "iban": "list_reduce(list_prepend(0::BIGINT, [CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT for c in string_split(substr(replace(hit, ' ', ''), 5) || left(hit, 4), '') if c <> '']), lambda a, b: CASE WHEN b > 9 THEN a * 100 + b ELSE a * 10 + b END % 97) = 1",
    "secret": "true",
}


def _pii_kind(i: int, kind: str) -> str:
    score = f"{pii.SCORE[kind]} + CASE WHEN regexp_matches(near, '(?:^|[^a-z0-9])(?:{pii.WORDS[kind]})') THEN {pii.CONTEXT} ELSE 0 END >= {pii.THRESHOLD if kind in pii.ADDED else 0}"
    return f"""SELECT r, {i} AS k, '{kind}' AS kind, start, start + len(hit) AS stop FROM (
      SELECT r, hit, start, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, lower(substr(t, greatest(start - {pii.NEAR}, 0) + 1, start - greatest(start - {pii.NEAR}, 0))) AS near FROM (
        SELECT r, t, hits[i] AS hit, CAST(list_sum([len(gaps[j]) for j in range(1, i + 1)]) + coalesce(list_sum([len(hits[j]) for j in range(1, i)]), 0) AS BIGINT) AS start FROM (
          SELECT r, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, t, regexp_extract_all(t, '{_PII_PATTERNS[kind]}') AS hits, regexp_split_to_array(t, '{_PII_PATTERNS[kind]}') AS gaps FROM d))))
      WHERE {_PII_CHECKS[kind]} AND {score}"""


ORACLES["op8_personal_data"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_pii_kind(i, kind) for i, kind in enumerate(pii.KINDS))}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k < {len(pii.BASE)}), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans
      FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


def _steps(name: str, source: str, steps: list[dict[str, str]]) -> str:
    """CTEs that add columns step by step; the last one has the name."""
    parts = []
    for i, step in enumerate(steps):
        to = name if i == len(steps) - 1 else f"{name}_{i}"
        parts.append(f"{to} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})")
        source = to
    return ",\n".join(parts)


def _quality_sql() -> str:
    names, d = list(quality.FEATURES), len(quality.FEATURES)
    low = [(i, j) for i in range(d) for j in range(i + 1)]
    same = "{0}.lang IS NOT DISTINCT FROM {1}.lang AND {0}.source IS NOT DISTINCT FROM {1}.source"
    sql = [r"""base AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM base WHERE len(w) > 3),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win SEMI JOIN (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1) m USING (r, g)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
stat AS (SELECT r, doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(t) - len(translate(t, '""" + quality.MARKS.replace("'", "''") + r"""', '')) AS n_marks, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM base LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stat)""",
        "v AS (SELECT *, " + ", ".join(f"CASE WHEN NOT base_failed THEN CAST({e} AS BIGINT) END AS {f}" for f, e in quality.FEATURES.items()) + " FROM failed)",
        "fit AS (SELECT * FROM v WHERE NOT base_failed)",
        "med AS (SELECT lang, source, " + ", ".join(f"quantile_disc({f}, 0.5) AS x_{f}" for f in names) + " FROM fit GROUP BY ALL)",
        "mad AS (SELECT fit.lang, fit.source, " + ", ".join(f"any_value(x_{f}) AS x_{f}, quantile_disc(abs({f} - x_{f}), 0.5) AS y_{f}" for f in names) + f" FROM fit JOIN med ON {same.format('fit', 'med')} GROUP BY fit.lang, fit.source)",
        "est0 AS (SELECT lang, source, " + ", ".join(f"CAST(x_{f} AS DOUBLE) AS m_{i}" for i, f in enumerate(names)) + ", " + ", ".join(
            (f"sqrt(pow(1.4826 * y_{names[i]}, 2) + {quality.FLOOR[names[i]] ** 2})" if i == j else "CAST(0 AS DOUBLE)") + f" AS l_{i}_{j}" for i, j in low) + " FROM mad)"]
    sums = {"n": "count(*)"} | {f"s_{i}": f"sum({f})" for i, f in enumerate(names)} | {f"p_{i}_{j}": f"sum({names[i]} * {names[j]})" for i, j in low}
    est_cols = [f"m_{i}" for i in range(d)] + [f"l_{i}_{j}" for i, j in low]
    for k in range(quality.STEPS + 1):
        sql.append(f"at{k} AS (SELECT fit.*, {', '.join(est_cols)} FROM fit JOIN est{k} e ON {same.format('fit', 'e')})")
        sql.append(_steps(f"d{k}", f"at{k}", quality.distance_sql()))
        sql.append(f"cell{k} AS (SELECT lang, source, {quality.CLASS_SQL} AS c, {', '.join(f'{e} AS {n}' for n, e in sums.items())} FROM d{k} GROUP BY ALL)")
        sql.append(f"grown{k} AS (SELECT lang, source, c, n AS own, sum(n) OVER (PARTITION BY lang, source) AS all_n, {', '.join(f'sum({n}) OVER (PARTITION BY lang, source ORDER BY c) AS {n}' for n in sums)} FROM cell{k})")
        sql.append(f"near{k} AS (SELECT * FROM grown{k} WHERE n - own < {quality.KEEP} * all_n AND n >= {quality.KEEP} * all_n AND all_n >= {quality.LEAST})")
        if k < quality.STEPS:
            centre = {f"m_{i}": f"CAST(s_{i} AS DOUBLE) / n" for i in range(d)} | {f"w_{i}": f"CAST({quality.FLOOR[f] ** 2} AS DOUBLE)" for i, f in enumerate(names)}
            cov = {f"c_{i}_{j}": f"CAST(p_{i}_{j} AS DOUBLE) / n - m_{i} * m_{j}" + (f" + {quality.FLOOR[names[i]] ** 2}" if i == j else "") for i, j in low}
            sql.append(_steps(f"est{k + 1}", f"near{k}", [centre, cov, *quality.factor_sql()]))
    last = quality.STEPS
    sql.append(f"found AS (SELECT e.lang, e.source, {', '.join(est_cols)}, pow(2.0, CAST(x.c + 1 AS DOUBLE) / {quality.CLASSES} - 10) / {quality.MIDDLE} AS scale FROM near{last} x JOIN est{last} e ON {same.format('x', 'e')})")
    sql.append(f"placed AS (SELECT v.*, {', '.join(est_cols)}, scale FROM v LEFT JOIN found ON {same.format('v', 'found')})")
    sql.append(_steps("judged", "placed", quality.distance_sql()))
    return "WITH " + ",\n".join(sql) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(d2 / greatest(scale, 1.0) > {quality.CUT}, false) AS kept FROM judged"""


ORACLES["op4_quality_rules"] = _quality_sql()

_MARKS = len(chat.TURN) + 1 + len(chat.END)
ORACLES["op5_chat_windows"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i, len(regexp_extract_all(text, '{chat.WORD_OR_SIGN}')) + {chat.MARK_TOKENS} AS tokens,
        {_MARKS} + len(role) + len(regexp_replace(text, '([<\\[]\\\\*)({chat.CONTROL})', '\\1\\\\\\2', 'g')) AS chars FROM t),
p AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS upto FROM n),
f AS (SELECT *, upto - tokens AS begins FROM p),
sys AS (SELECT conv_id, tokens AS sys_tokens, chars AS sys_chars FROM f WHERE begins = 0 AND role = 'system'),
c AS (SELECT f.*, sys_chars, greatest(1, ({chat.BUDGET} - {chat.HISTORY_TOKENS} - least(coalesce(sys_tokens, 0), {chat.BUDGET // 2})) // 2) AS cell FROM f LEFT JOIN sys USING (conv_id)),
g AS (SELECT *, 2 * (begins // cell) + CASE WHEN tokens > cell THEN 1 ELSE 0 END AS span FROM c),
w AS (SELECT conv_id, span, min(begins) AS start, max(upto) AS stop, sum(chars) AS chars, any_value(sys_chars) AS sys_chars FROM g GROUP BY conv_id, span),
old AS (SELECT g.conv_id, w.stop, g.chars, row_number() OVER (PARTITION BY g.conv_id, w.stop ORDER BY g.begins DESC) AS back
        FROM g JOIN w ON w.conv_id = g.conv_id AND w.span = g.span WHERE w.stop - g.begins <= {chat.HISTORY_TOKENS} AND NOT (g.begins = 0 AND g.role = 'system')),
h AS (SELECT conv_id, stop, sum(chars) AS chars FROM old WHERE back <= {chat.HISTORY_TURNS} GROUP BY conv_id, stop),
shown AS (SELECT w.conv_id, sum({len(chat.BEGIN)} + w.chars + coalesce(h.chars, 0) + CASE WHEN start > 0 THEN coalesce(sys_chars, 0) ELSE 0 END) AS formatted_chars
          FROM w LEFT JOIN h ON h.conv_id = w.conv_id AND h.stop = w.start GROUP BY w.conv_id),
said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said JOIN shown USING (conv_id)
"""
