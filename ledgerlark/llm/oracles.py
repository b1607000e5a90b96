"""DuckDB SQL of the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_KEY = LOWER.format(f"trim(line, {BLANKS})")
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
TERMS = "regexp_extract_all(" + LOWER.format("text") + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
ESCAPED = r"replace(replace(replace(coalesce({}, ''), '\', '\b'), '<', '\l'), '>', '\g')"

SQL = {
    "op5_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM split),
keyed AS (SELECT *, {LINE_KEY} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k
           HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_decontamination": f"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, 10 AS n, w[s:s + 9] AS win FROM (SELECT *, unnest(range(1, len(w) - 8)) AS s FROM iw WHERE len(w) >= 10)
  UNION SELECT item_id, len(w), w FROM iw WHERE len(w) BETWEEN 1 AND 9),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
sizes AS (SELECT DISTINCT n FROM windows),
probes AS (SELECT doc_id, p, n, w[p:p + n - 1] AS win FROM spots CROSS JOIN sizes WHERE p + n - 1 <= len(w)),
occurring AS (SELECT DISTINCT doc_id, p, n, item_id FROM probes JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occurring) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM occurring GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                length({ESCAPED.format("role")}) + length({ESCAPED.format("text")}) + 15 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id""",
    "op11_collocations": rf"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words),
f AS (SELECT lang, w[s:s + k - 1] AS p, count(*) AS a FROM spots CROSS JOIN range(1, 6) AS t(k) WHERE s + k - 1 <= len(w) GROUP BY ALL HAVING a >= 100),
cand AS (SELECT * FROM f WHERE len(p) >= 2),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM cand),
scored AS (SELECT c.lang, c.p, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]
           JOIN sizes ON sizes.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (SELECT lang, p[s:s + k - 1] AS p, max(a) AS longest FROM (
             SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS s FROM (
               SELECT lang, p, a, unnest(range(2, len(p))) AS k FROM cand WHERE len(p) > 2)) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.p, ' ') AS phrase FROM best LEFT JOIN inner_ USING (lang, p) WHERE coalesce(100 * longest < 100 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000""",
    "op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
said AS (SELECT id, lang, source, unnest({TERMS}) AS term FROM d),
vocab AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM vocab GROUP BY lang),
kept AS (SELECT said.lang, source, said.term, count(*) AS c FROM said JOIN vocab USING (lang, term) GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM d),
tok AS (SELECT lang, source, sum(c) AS n FROM kept GROUP BY ALL),
p AS (SELECT g.lang, g.source, w.term, coalesce(k.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(k.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * s.v) AS p
      FROM grps g JOIN vocab w USING (lang) JOIN sizes s USING (lang) LEFT JOIN tok t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = w.term),
ltok AS (SELECT lang, sum(n) AS n FROM tok GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (any_value(l.n) + 2 * any_value(s.v)) AS q
      FROM kept JOIN ltok l USING (lang) JOIN sizes s USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM grps a JOIN grps b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          WHERE a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
