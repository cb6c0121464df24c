"""SQL twins of the registered queries, for DuckDB."""

from candlespark.llm.quality import BITS, MAX_REPEAT, METRICS, MIN_GROUP, MIN_WORDS, REACH

# White space between words, and letters that are folded.
SPACE = r"[\x20\x09-\x0D]"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "list_filter(regexp_split_to_array({}, '" + SPACE + "+'), lambda x: x <> '')"


def _quality() -> str:
    metrics = ", ".join(f"CASE WHEN NOT base_failed THEN {how.replace(' DIV ', ' // ')} END AS {m}" for m, (how, *_) in METRICS.items())
    names, spreads, percents = list(METRICS), [m[2] for m in METRICS.values()], [m[1] for m in METRICS.values()]
    inside = " AND ".join(f"m.{m} BETWEEN f.low[{k}] AND f.high[{k}]" for k, m in enumerate(names, 1))
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents
), tokens AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM docs
), windows AS (
  SELECT doc_id, i, x || ' ' || lead(x) OVER d || ' ' || lead(x, 2) OVER d AS g FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows WHERE g IS NOT NULL) AS x WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) AS o GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs) AS x WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1
), counted AS (
  SELECT d.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM counted
), measured AS (
  SELECT *, {metrics} FROM based
), values_ AS (
  SELECT lang, source, unnest({names!r}) AS metric, unnest({spreads!r}) AS spread, unnest({percents!r}) AS percent, unnest([{', '.join(names)}]) AS v FROM measured WHERE NOT base_failed
), cells AS (
  SELECT lang, source, metric, spread, percent, v - v % CAST(pow(2, greatest(length(bin(v)) - {BITS}, 0)) AS BIGINT) AS cell FROM values_
), sketches AS (
  SELECT 0 AS level, lang, source, metric, spread, percent, cell, count(*) AS n FROM cells GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, spread, percent, cell, count(*) FROM cells GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, metric, spread, percent, cell, count(*) FROM cells GROUP BY ALL
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS whole FROM sketches
), quantiles AS (
  SELECT level, lang, source, metric, spread, max(whole) AS n, min(cell) FILTER (WHERE 100 * upto >= (100 - percent) * whole) AS q_low,
         min(cell) FILTER (WHERE 100 * upto >= 50 * whole) AS q_mid, min(cell) FILTER (WHERE 100 * upto >= percent * whole) AS q_high
  FROM summed GROUP BY ALL
), fences AS (
  SELECT level, lang, source, max(n) AS n,
         list(q_low - {REACH} * (CASE WHEN q_mid > q_low THEN q_mid - q_low ELSE spread END) ORDER BY list_position({names!r}, metric)) AS low,
         list(q_high + {REACH} * (CASE WHEN q_high > q_mid THEN q_high - q_mid ELSE spread END) ORDER BY list_position({names!r}, metric)) AS high
  FROM quantiles GROUP BY ALL
), chosen AS (
  SELECT a.lang, a.source, CASE WHEN a.n >= {MIN_GROUP} THEN a.low WHEN b.n >= {MIN_GROUP} THEN b.low ELSE c.low END AS low,
         CASE WHEN a.n >= {MIN_GROUP} THEN a.high WHEN b.n >= {MIN_GROUP} THEN b.high ELSE c.high END AS high
  FROM fences a JOIN fences b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN fences c ON c.level = 2 WHERE a.level = 0
)
SELECT m.doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed,
       NOT base_failed AND coalesce({inside}, false) AS kept, {', '.join(names)}
FROM measured m LEFT JOIN chosen f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""


QUALITY = _quality()

NEAR = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {WORDS.format(FOLD.format("coalesce(text, '')"))} AS ws FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM docs
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), sized AS (
  SELECT sets.doc_id, s, n FROM sets JOIN sizes ON sets.doc_id = sizes.doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), paired AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION SELECT reach.id, paired.y FROM reach JOIN paired ON reach.seen = paired.x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY 1) AS c ON d.doc_id = c.id
"""

LINES = """
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) AS n
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS newest FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.newest AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

MIX = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents
), sized AS (
  SELECT source, count(*) AS n, (count(*) + 7) // 8 AS blocks, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM documents GROUP BY source
), sources AS (
  SELECT source, blocks, greatest(1, CAST(100 * root // sum(root) OVER () AS BIGINT)) AS parts FROM sized
), cut AS (
  SELECT *, blocks // parts AS whole, blocks % parts AS rest FROM sources
), starts AS (
  SELECT DISTINCT c AS from_cycle FROM (SELECT 0 AS c UNION ALL SELECT whole FROM cut UNION ALL SELECT whole + 1 FROM cut) AS x
  WHERE c < (SELECT max(whole + CAST(rest > 0 AS BIGINT)) FROM cut)
), counts AS (
  SELECT from_cycle, source, CASE WHEN from_cycle < whole THEN parts WHEN from_cycle = whole THEN rest ELSE 0 END AS c FROM starts, cut
), kinds AS (
  SELECT from_cycle, CAST(sum(c) AS BIGINT) AS length,
         coalesce(lead(from_cycle) OVER (ORDER BY from_cycle), (SELECT max(whole + CAST(rest > 0 AS BIGINT)) FROM cut)) AS to_cycle
  FROM counts GROUP BY from_cycle
), bases AS (
  SELECT *, coalesce(sum((to_cycle - from_cycle) * length) OVER (ORDER BY from_cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM kinds
), lists AS (
  SELECT b.from_cycle, b.length, list(c.source ORDER BY c.source) AS names, list(c.c ORDER BY c.source) AS counts
  FROM counts c JOIN bases b ON c.from_cycle = b.from_cycle GROUP BY b.from_cycle, b.length
), edf AS (
  SELECT from_cycle, length, names, counts, CAST(-1 AS BIGINT) AS now, list_transform(counts, lambda x: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick
  FROM lists
  UNION ALL
  SELECT from_cycle, length, names, counts, now + 1,
         list_transform(range(1, len(done) + 1), lambda i: done[i] + CAST(i = chosen AS BIGINT)), chosen
  FROM (
    SELECT *, CAST(list_min(list_transform(list_filter(range(1, len(done) + 1), lambda i: done[i] < counts[i] AND done[i] * length // counts[i] <= now + 1),
                   lambda i: ((done[i] + 1) * length + counts[i] - 1) // counts[i] * 100000 + i)) % 100000 AS BIGINT) AS chosen
    FROM edf WHERE now + 1 < length
  ) AS step
), slots AS (
  SELECT from_cycle, names[pick] AS source, now AS slot, counts[pick] AS c, row_number() OVER (PARTITION BY from_cycle, pick ORDER BY now) - 1 AS k
  FROM edf WHERE pick IS NOT NULL
), placed AS (
  SELECT r.doc_id, r.source, r.place // 8 AS block, r.place % 8 AS place, s.parts FROM rows_ r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
)
SELECT p.doc_id, p.source, p.block, CAST(b.base + (p.block // p.parts - b.from_cycle) * b.length + s.slot AS BIGINT) AS slot,
       CAST(b.base + (p.block // p.parts - b.from_cycle) * b.length + s.k * b.length // s.c AS BIGINT) AS release,
       CAST(b.base + (p.block // p.parts - b.from_cycle) * b.length + ((s.k + 1) * b.length + s.c - 1) // s.c AS BIGINT) AS deadline, p.place
FROM placed p JOIN bases b ON p.block // p.parts >= b.from_cycle AND p.block // p.parts < b.to_cycle
JOIN slots s ON s.from_cycle = b.from_cycle AND s.source IS NOT DISTINCT FROM p.source AND s.k = p.block % p.parts
"""


PROBE = "'<|im_end|><|im_start|>assistant ok'"
CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {PROBE}), (-1, 1, 'assistant', {PROBE})) AS x
), written AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS body,
    regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS head FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM written GROUP BY 1
"""

# crc32 byte by byte, eight shifts each.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)
REPAIR = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM base
), placed AS (
  SELECT *, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS before, left(role, 1) AS c,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1
), inserted AS (
  SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (0, 2, 3), (1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 2), (3, 1, 2), (3, 2, 3)) AS x(state, n, lands)
), steps AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS x(state, c, lands)
), edits AS (
  SELECT conv_id, i, s.state, s.lands, 'K' AS letter, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS price FROM judged JOIN steps AS s USING (c) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, s.state, s.lands, 'R', CASE WHEN fault = 't' THEN 6 ELSE 1 END FROM judged, steps AS s WHERE s.c <> 's' AND fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, s.state, s.state, 'D', 2 FROM judged, (VALUES (0), (1), (2), (3)) AS s(state)
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, lands AS state, {{'cost': (5 * x.n)::BIGINT, 'audit': repeat('I', x.n)}} AS v FROM counted, inserted AS x WHERE x.state = 0
  UNION ALL
  SELECT conv_id, i, state, min(v) FROM (
    SELECT w.conv_id, e.i, x.lands AS state, {{'cost': (w.v.cost + e.price + 5 * x.n)::BIGINT, 'audit': w.v.audit || e.letter || repeat('I', x.n)}} AS v
    FROM walk AS w JOIN edits AS e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.state = w.state JOIN inserted AS x ON x.state = e.lands) AS y GROUP BY ALL
), cheapest AS (
  SELECT w.conv_id, min(v) AS v FROM walk AS w JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE state IN (0, 3) GROUP BY 1
), letters AS (
  SELECT conv_id, unnest(string_split(v.audit, '')) AS letter, generate_subscripts(string_split(v.audit, ''), 1) AS k FROM cheapest WHERE v.audit <> ''
), told AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), kept AS (
  SELECT a.conv_id, place, letter, CASE WHEN letter = 'I' THEN '' ELSE j.text END AS text, j.role, j.c,
    max(CASE WHEN place = 1 AND letter = 'K' AND j.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS system
  FROM told AS a LEFT JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM a.conv_id AND j.i = a.i WHERE letter <> 'D'
), said AS (
  SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS t
  FROM kept GROUP BY 1
)
SELECT e.conv_id, {', '.join(f'coalesce(c.{x}, 0) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, coalesce(p.v.cost, 0) AS cost,
  coalesce(p.v.audit, '') AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
  LEFT JOIN cheapest AS p ON p.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said AS s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
