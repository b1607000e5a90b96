"""Queries on chunks, entities, topics and quality gates."""

from functools import reduce

from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import chapters, chunking, dictionary, gates, graph, names

from .registry import query

WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda w: w <> '')"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, {WORDS.format('text')} AS w FROM documents),
    s AS (SELECT doc_id, raw, w, CASE WHEN len(w) > 200 THEN unnest(range(0, len(w), 150)) ELSE 0 END AS start FROM d WHERE len(w) > 200
      UNION ALL SELECT doc_id, raw, w, 0 FROM d WHERE len(w) <= 200),
    c AS (SELECT doc_id, (start // 150)::INT AS chunk_index, CASE WHEN len(w) <= 200 THEN raw ELSE array_to_string(w[start + 1:start + 200], ' ') END AS content, len(w[start + 1:start + 200])::INT AS word_count FROM s)
    SELECT * FROM c WHERE word_count >= 10""",
)
def word_window_chunks(documents):
    """Overlapping windows of words (CHK1, CHK2)."""
    return chunking.word_windows(documents, "doc_id", "text", 200, 50)


def _pack_sql(name: str, rows: str, most: int, glue: str, key: str = "doc_id") -> str:
    """SQL of a recursive relation ``name`` (key, g, k, c): the texts p of each (key, g), by place i from 1 on, packed."""
    fits = f"length(c) + length(p) + 1 <= {most}"
    return f"""{name}r AS (SELECT {key}, g, i, p AS c, 0 AS k FROM {rows} WHERE i = 1 UNION ALL SELECT r.{key}, r.g, n.i, CASE WHEN {fits} THEN c || {glue} || p ELSE p END, k + (NOT ({fits}))::INT
    FROM {name}r r JOIN {rows} n ON n.{key} = r.{key} AND n.g = r.g AND n.i = r.i + 1), {name} AS (SELECT {key}, g, k, arg_max(c, i) AS c FROM {name}r GROUP BY ALL)"""


def _packed_sql(most: int, least: int) -> str:
    """DuckDB SQL of the chunks of lines: sentences of long lines are packed first, then all pieces."""

    return rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents),
    t AS (SELECT doc_id, g, trim(p) AS p FROM l WHERE trim(p) <> ''), s0 AS (SELECT doc_id, g, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM t WHERE length(p) > {most}),
    s AS (SELECT doc_id, g, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM s0), {_pack_sql('a', 's', most, "' '")},
    w AS (SELECT doc_id, 0 AS g, c AS p, row_number() OVER (PARTITION BY doc_id ORDER BY g, k) AS i FROM (SELECT doc_id, g, k, c FROM a UNION ALL SELECT doc_id, g, 0, p FROM t WHERE length(p) <= {most})),
    {_pack_sql('b', 'w', most, 'chr(10)')}, k AS (SELECT doc_id, k, c FROM b WHERE length(c) >= {least}
    UNION ALL SELECT doc_id, 0, trim(text, ' ' || chr(10) || chr(9)) FROM documents d WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id AND length(b.c) >= {least}))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, c AS content FROM k"""


@query("documents", sql=_packed_sql(800, 0))
def paragraph_chunks(documents):
    """Lines packed to chunks of at most 800 characters (CHK3, CHK9)."""
    return chunking.paragraph_chunks(documents, "doc_id", "text", 800, "\n")


@query("documents", sql=_packed_sql(1500, 200))
def large_paragraph_chunks(documents):
    """Chunks of about 1500 characters, small ones dropped (CHK4)."""
    return chunking.paragraph_chunks(documents, "doc_id", "text", 1500, "\n", 200)


@query(
    "documents",
    sql=r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM l),
    m AS (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN line ELSE '  § ' || (doc_id % 90) || '-' || n || CASE WHEN n % 2 = 0 THEN '.1A' ELSE '' END || '. Part ' || (n % 7) || '. ' || line END AS line FROM p),
    g AS (SELECT doc_id, sum((line LIKE '  §%')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k, n, line FROM m),
    q0 AS (SELECT doc_id, k, trim(string_agg(line, chr(10) ORDER BY n), ' ' || chr(10) || chr(9) || chr(13) || chr(11) || chr(12)) AS c FROM g GROUP BY 1, 2),
    q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, c, trim(regexp_extract(c, '^(§\s*[\d.-]+[A-Z]?)', 1)) AS s, regexp_extract(c, '^§\s*[\d.-]+[A-Z]?\.?\s+([^.]+)', 1) AS t FROM q0 WHERE c <> ''),
    r AS (SELECT doc_id, i, 0 AS k, c, s, t FROM q WHERE i = 1 UNION ALL
      SELECT r.doc_id, q.i, CASE WHEN length(r.c) <= 2000 AND length(q.c) < 300 THEN r.k ELSE r.k + 1 END, CASE WHEN length(r.c) <= 2000 AND length(q.c) < 300 THEN r.c || chr(10) || chr(10) || q.c ELSE q.c END,
      CASE WHEN length(r.c) > 2000 AND q.s = '' THEN r.s WHEN length(r.c) > 2000 OR length(q.c) >= 300 THEN q.s WHEN r.s = '' THEN q.s ELSE r.s END,
      CASE WHEN length(r.c) > 2000 AND q.t = '' THEN r.t WHEN length(r.c) > 2000 OR length(q.c) >= 300 THEN q.t WHEN r.s = '' THEN q.t ELSE r.t END
      FROM r JOIN q ON q.doc_id = r.doc_id AND q.i = r.i + 1),
    w AS (SELECT doc_id, k, arg_max(c, i) AS c, arg_max(s, i) AS s, arg_max(t, i) AS t FROM r GROUP BY 1, 2)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, md5(c) AS digest, s AS section, t AS title FROM w WHERE length(c) >= 100""",
)
def section_chunks(documents):
    """Sections of a code with numbers of several forms, small ones merged, tiny ones dropped (CHK7, SRC16)."""
    text = lambda c: c.cast("string")
    sign = lambda n: F.concat(F.lit("  § "), text(F.col("doc_id") % 90), F.lit("-"), text(n), F.when(n % 2 == 0, ".1A").otherwise(""), F.lit(". Part "), text(n % 7), F.lit(". "))
    marked = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(i % 3 == 2, line).otherwise(F.concat(sign(i + 1), line)))
    found = chunking.section_chunks(documents.select("doc_id", F.array_join(marked, "\n").alias("text")), "doc_id", "text")
    return found.select("doc_id", "chunk_index", F.md5("content").alias("digest"), "section", "title")


FRONT_LINES = ["§ 9-1. One.      § 9-2. Two.", "[HISTORY: Adopted", "in 1990.]", "GENERAL REFERENCES", "Zoning — See Ch. 230.      Dogs — See", "Ch. 7.", "ARTICLE IV", "General", ""]


def _chapters(documents):
    """Chapters of a code: a document's lines below headings, notes and page numbers; two in three have front matter."""
    n = lambda i: i.cast("string")
    heading = lambda i: F.concat(F.lit("§ 9-"), n(i), F.lit(". Part"), F.when(i % 2 == 0, " [Amended 2001]").otherwise(""))
    around = lambda x, i: F.array(F.when(i % 5 == 0, heading(i)), F.when(i % 7 == 0, n(i)), F.when(i % 11 == 0, "3. Editor's Note: see"), x, F.when(i % 4 == 0, ""))
    body = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.filter(around(x, i + 1), lambda y: y.isNotNull())))
    front = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in FRONT_LINES]))
    return documents.select("doc_id", F.lit("Noise").alias("title"), F.array_join(F.concat(front, body), "\n").alias("text"))


_FRONT_SQL = ", ".join(f"'{x}'" for x in FRONT_LINES)
_LINES_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE [{_FRONT_SQL}] END, flatten(list_transform(range(1, len(t) + 1), lambda i: list_filter([CASE WHEN i % 5 = 0 THEN '§ 9-' || i || '. Part' || CASE WHEN i % 2 = 0 THEN ' [Amended 2001]' ELSE '' END END,
      CASE WHEN i % 7 = 0 THEN i::VARCHAR END, CASE WHEN i % 11 = 0 THEN '3. Editor''s Note: see' END, t[i], CASE WHEN i % 4 = 0 THEN '' END], lambda v: v IS NOT NULL)))) AS l FROM d),
    e AS (SELECT doc_id, unnest(range(len(l)))::INT AS n, unnest(l) AS line, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 4 END AS f FROM x),
    c AS (SELECT doc_id, n, line, contains(line, ']') AS closes, length(trim(line)) < 60 AND NOT regexp_matches(line, '^\s*[(\[]?[0-9A-Za-z]{{1,4}}[.)\]]\s') AS short,
      CASE WHEN NOT regexp_matches(line, '\S') THEN 'blank' WHEN regexp_matches(line, '^\s*\d{{1,4}}\s*$') OR trim(line) = 'NOISE' THEN 'mark' WHEN contains(line, '[HISTORY') THEN 'history' WHEN trim(line) = 'GENERAL REFERENCES' THEN 'references'
      WHEN n >= f AND regexp_matches(line, '^\s*ARTICLE\s+[IVXLC]+[A-Z]*\s*$') THEN 'article' WHEN n >= f AND regexp_matches(line, '^§ 9-\d+\. .*\]$') THEN 'section' WHEN n >= f AND regexp_matches(line, '^§ 9-\d+\. ') THEN 'open'
      WHEN regexp_matches(line, '^\s*\d{{1,3}}\. Editor''s Note') THEN 'note' ELSE 'plain' END AS k FROM e),
    s AS (SELECT doc_id, -1 AS n, '' AS kind, 'front' AS st FROM d UNION ALL SELECT doc_id, n, kind,
        CASE WHEN k = 'blank' THEN CASE WHEN st IN ('note', 'article', 'title') THEN 'body' ELSE st END WHEN k = 'mark' THEN st WHEN k = 'article' THEN 'article' WHEN k = 'section' THEN 'body' WHEN k = 'open' THEN 'title'
        WHEN kind = 'history' THEN CASE WHEN closes THEN 'front' ELSE 'history' END WHEN kind IN ('references', 'note') THEN kind WHEN st = 'title' THEN 'body' ELSE st END
      FROM (SELECT c.doc_id, c.n, k, closes, st, CASE WHEN k = 'blank' THEN 'blank' WHEN k = 'mark' THEN 'page mark' WHEN k = 'article' THEN 'article' WHEN k IN ('section', 'open') THEN 'section'
        WHEN st IN ('front', 'history', 'references') AND k IN ('history', 'references') THEN k WHEN st NOT IN ('front', 'history', 'references') AND k = 'note' THEN 'note'
        WHEN st = 'front' THEN 'contents' WHEN st = 'history' THEN 'history' WHEN st = 'references' THEN 'reference' WHEN st = 'title' AND short AND k = 'plain' THEN 'section title' WHEN st IN ('title', 'body') THEN 'text'
        WHEN st = 'note' THEN 'note' ELSE 'article title' END AS kind FROM s JOIN c ON c.doc_id = s.doc_id AND c.n = s.n + 1)),
    a AS (SELECT doc_id, n AS line, kind, (sum((kind IN ('article', 'section'))::INT) OVER (PARTITION BY doc_id ORDER BY n))::INT AS item, c.line AS content FROM s JOIN c USING (doc_id, n))"""


@query("documents", sql=_LINES_SQL + " SELECT doc_id, line, kind, item, md5(content) AS digest FROM a")
def code_lines(documents):
    """What each line of a code's chapters is (SRC16)."""
    lines = chapters.chapter_lines(_chapters(documents), "doc_id", "text", "title")
    return lines.select("doc_id", "line", "kind", "item", F.md5("content").alias("digest"))


@query(
    "documents",
    sql=_LINES_SQL
    + r""", g AS (SELECT doc_id, item, min(kind) FILTER (kind IN ('article', 'section')) AS kind, string_agg(trim(content), '' ORDER BY line) FILTER (kind IN ('article', 'section')) AS head,
      string_agg(trim(content), ' ' ORDER BY line) FILTER (kind IN ('article title', 'section title')) AS more, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (kind = 'text'), '') AS body,
      coalesce(string_agg(trim(content), ' ' ORDER BY line) FILTER (kind = 'note'), '') AS notes FROM a WHERE item > 0 GROUP BY 1, 2)
    SELECT doc_id, item, kind, CASE WHEN kind = 'section' THEN regexp_extract(head, '^§ (9-\d+)', 1) ELSE 'IV' END AS label,
      trim(concat_ws(' ', CASE WHEN kind = 'section' THEN 'Part' END, more)) AS title, CASE WHEN contains(head, '[Amended') THEN 'Amended 2001' END AS amended,
      md5(body) AS digest, notes, CASE WHEN doc_id % 3 <> 0 THEN 'IV' END AS article FROM g""",
)
def code_items(documents):
    """Articles and sections of a code's chapters, with titles, notes and what was amended (SRC16)."""
    found = chapters.chapter_items(chapters.chapter_lines(_chapters(documents), "doc_id", "text", "title"), "doc_id")
    return found.withColumn("digest", F.md5("content")).drop("content")


@query(
    "conversations",
    sql=rf"""WITH RECURSIVE c AS (SELECT conv_id, turn AS g, repeat(text || ' ', 4) AS text FROM conversations), s0 AS (SELECT conv_id, g, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM c WHERE length(text) > 300),
    s AS (SELECT conv_id, g, unnest(s) AS p, generate_subscripts(s, 1) AS i FROM s0), {_pack_sql('a', 's', 300, "' '", 'conv_id')},
    u AS (SELECT conv_id, g, k, c FROM a WHERE c <> '' UNION ALL SELECT conv_id, g, 0, text FROM c WHERE length(text) <= 300),
    b AS (SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY conv_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
    SELECT conv_id, b.g AS turn, k AS piece, b.g + before / length(text) AS start, least(b.g + 1.0, b.g + (before + length(b.c)) / length(text)) AS "end", b.c AS text FROM b JOIN c USING (conv_id, g)""".replace("\\\\", "\\"),
)
def turn_chunks(conversations):
    """Turns cut at sentences, each piece with its share of the time (CHK5, MTH8)."""
    said = F.repeat(F.concat("text", F.lit(" ")), F.lit(4))
    timed = conversations.select("conv_id", "turn", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.0).alias("end"), said.alias("text"))
    return chunking.timed_pieces(timed, 300)


@query(
    "conversations",
    sql=f"""SELECT conv_id, count(*) AS utterances, count(DISTINCT role) AS speakers, sum(len({WORDS.format('text')}))::BIGINT AS words, max(turn) AS duration FROM conversations GROUP BY 1""",
)
def transcript_stats(conversations):
    """Size of each transcript (ETL1, ETL2)."""
    return chunking.transcript_stats(conversations, "conv_id", "role", "text", "turn")


# ---- entities and topics ----------------------------------------------------------------------------------


@query(
    "part",
    "lineitem",
    sql="""SELECT lower(replace(p_name, ' ', '-')) AS slug, min(p_name) AS name, count(*) AS n, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def entity_states(part, lineitem):
    """Entities by slug with counts and dates, two arrivals merged (GRA1, SNK4, STR1)."""
    seen = lineitem.join(part, lineitem.l_partkey == part.p_partkey).select("p_name", "l_shipdate")
    old, new = (seen.where(f"l_shipdate {c} timestamp '1998-01-01'") for c in ("<", ">="))
    return graph.entity_states(new, "p_name", "l_shipdate", graph.entity_states(old, "p_name", "l_shipdate"))


@query("conversations", sql="SELECT role, conv_id, count(*) AS weight FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2")
def spoke_at_edges(conversations):
    """Edges from speakers to events (GRA2)."""
    return graph.spoke_at(conversations, "conv_id", "role")


@query(
    "part",
    sql="""SELECT coalesce(CASE p_name WHEN 'red plate' THEN 'crimson plate' WHEN 'blue plate' THEN 'navy plate' END, p_name) AS p_name, count(*) AS n FROM part GROUP BY 1""",
)
def alias_merge(part):
    """Aliases replaced by a configured list (GRA4, STR15)."""
    merged = graph.merge_aliases(part.select("p_name"), "p_name", [("red plate", "crimson plate"), ("blue plate", "navy plate")])
    return merged.groupBy("p_name").agg(F.count("*").alias("n"))


_TITLED = "CASE WHEN p_partkey % 3 = 0 THEN 'Mayor ' || p_name WHEN p_partkey % 3 = 1 THEN 'Trustee ' || p_name ELSE p_name END"


def _titled(part):
    name = F.col("p_name")
    third = F.col("p_partkey") % 3
    return part.select(
        F.when(third == 0, F.concat(F.lit("Mayor "), name)).when(third == 1, F.concat(F.lit("Trustee "), name)).otherwise(name).alias("p_name")
    )


@query(
    "part",
    sql=f"""WITH n AS (SELECT DISTINCT {_TITLED} AS name FROM part), b AS (SELECT name, lower(regexp_replace(name, '^(Mayor|Trustee) ', '')) AS bare FROM n),
    r AS (SELECT *, first_value(name) OVER (PARTITION BY bare ORDER BY (name LIKE 'Mayor %' OR name LIKE 'Trustee %')::INT, length(name), name) AS canonical FROM b)
    SELECT name, canonical FROM r""",
)
def canonical_pick(part):
    """One name for those that differ by a title (GRA5, STR8)."""
    return graph.canonical_names(_titled(part), "p_name")


@query(
    "part",
    sql="""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_size < 10),
    l AS (SELECT split_part(name, ' ', 2) AS last, min(name) AS canonical FROM n WHERE contains(name, ' ') GROUP BY 1 HAVING count(*) = 1)
    SELECT n.name, canonical FROM n JOIN l ON n.name = l.last WHERE NOT contains(n.name, ' ')""",
)
def single_match_merge(part):
    """Last names that belong to exactly one longer name (GRA6, STR9)."""
    names = part.select("p_name").union(part.where("p_size < 10").select(F.split("p_name", " ")[1]))
    return graph.single_match(names, "p_name")


@query(
    "part",
    sql=f"""SELECT name, CASE WHEN name = 'Mayor red plate' THEN 'Chair' WHEN name LIKE 'Mayor %' THEN 'Mayor' WHEN name LIKE 'Trustee %' THEN 'Trustee' ELSE 'Resident' END AS role
    FROM (SELECT DISTINCT {_TITLED} AS name FROM part)""",
)
def assigned_roles(part):
    """Role by list, else by title, else a default (GRA8, EXT2)."""
    names = _titled(part).distinct()
    curated = F.when(F.col("p_name") == "Mayor red plate", "Chair")
    return names.select(F.col("p_name").alias("name"), graph.role_of(F.col("p_name"), curated).alias("role"))


@query(
    "part",
    sql="""WITH t(alias, canonical, place) AS (VALUES ('crimson plate', 'crimson plate', 0), ('red plate', 'crimson plate', 1), ('blue plate', 'crimson plate', 2), ('red widget', 'widget one', 1), ('green widget', 'widget one', 2)),
    p AS (SELECT p_partkey AS id, p_name AS name, canonical, place FROM part LEFT JOIN t ON p_name = alias),
    s AS (SELECT *, CASE WHEN canonical IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY canonical ORDER BY place, id) END AS survivor FROM p)
    SELECT id, coalesce(canonical, name) AS name, replace(lower(coalesce(canonical, name)), ' ', '-') AS slug, survivor, coalesce(id = survivor AND name <> canonical, false) AS renamed FROM s""",
)
def alias_survivors(part):
    """Which row stays for each canonical name; without a row of that name the first alias is renamed (GRA4)."""
    entities = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    names = {"crimson plate": ["red plate", "blue plate"], "widget one": ["red widget", "green widget"]}
    return graph.alias_survivors(entities, "id", "name", names)


_PERSON = "'Ann ' || upper(chr(97 + (o_custkey % 26)::INT)) || chr(97 + (o_custkey % 7)::INT) || 'ker'"


@query(
    "orders",
    sql=f"""WITH m AS (SELECT o_orderkey AS k, {_PERSON} AS who, o_orderkey % 6 AS c FROM orders),
    e AS (SELECT k, 0 AS part, who AS name, CASE WHEN c = 0 THEN 'Trustee' ELSE 'Member' END AS role, 'attendance' AS source, 1 AS counted FROM m WHERE c < 3
      UNION ALL SELECT k, 1, who, 'Staff', 'staff', 1 FROM m WHERE c = 3 UNION ALL SELECT k, 2, who, 'Member', 'motion', 1 FROM m WHERE c = 4
      UNION ALL SELECT k, 3, who, CASE WHEN k % 4 = 1 THEN 'Clerk' ELSE 'President' END, 'title', 0 FROM m WHERE c IN (1, 5)),
    o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, part) AS i FROM e)
    SELECT name, (sum(counted) + max((i = 1 AND counted = 0)::INT))::BIGINT AS n, coalesce(arg_max(role, i) FILTER (WHERE counted = 0), arg_min(role, i)) AS role, arg_min(source, i) AS source FROM o GROUP BY name""",
)
def names_of_minutes(orders):
    """Names over all minutes: how often, in which role at first, and the more specific one said later (EXT2)."""
    k, c = F.col("o_custkey"), F.col("o_orderkey") % 6
    letter = lambda n: F.char(97 + k % n)
    who = F.concat(F.lit("Ann "), F.upper(letter(26)), letter(7), F.lit("ker"))
    none = F.array().cast("array<string>")
    title = F.when(F.col("o_orderkey") % 4 == 1, "Clerk").otherwise("President")
    minutes = orders.select(
        "o_orderkey",
        F.when(c == 0, F.array(F.concat(F.lit("Dr. "), who, F.lit(" (by phone) , Trustee")))).when(c < 3, F.array(who, F.lit("Al"))).otherwise(none).alias("attendees"),
        F.when(c == 3, F.array(F.concat(F.lit(" "), who), F.lit("every person who came"), F.lit("Bo"))).otherwise(none).alias("also_present"),
        F.when(c == 4, F.array(F.concat(F.lit("Mrs. "), who), F.lit(None).cast("string"))).otherwise(none).alias("movers"),
        F.when((c == 1) | (c == 5), F.concat(F.lit("It was so. "), title, F.lit(" "), who, F.lit(" spoke."))).otherwise("none").alias("text"),
    )
    return graph.names_of_minutes(minutes, "o_orderkey", "Member", {"Clerk": "Clerk", "President": "President"})


#: Corrections in order; later ones meet what earlier ones leave.
PASSES = [("the ", "teh "), ("teh the", "the"), ("and", "&"), ("& ", "and "), ("ing of", "ed of"), ("icense", "ICENSE"), ("LICENSE", "licence"), (" idiot", " person"), ("\n\n", "\n"), ("ed of teh", "of the")]


def _passes_sql() -> str:
    """Nested replacements of a text in DuckDB."""
    return reduce(lambda sql, p: "replace({}, {}, {})".format(sql, *("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in p)), PASSES, "text")


@query("documents", sql=f"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_passes_sql()} AS t FROM documents)")
def dictionary_passes(documents):
    """Texts after a dictionary of corrections, in order (STR15, STR26)."""
    fixed = documents.select("doc_id", dictionary.replaced(F.col("text"), PASSES).alias("t"))
    return fixed.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    "documents",
    sql="""WITH t AS (SELECT 'licences' AS topic, doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%copyright%'
    UNION SELECT 'insults', doc_id FROM documents WHERE text ILIKE '%idiot%' OR text ILIKE '%moron%')
    SELECT topic, count(*) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM t GROUP BY 1""",
)
def topic_seed(documents):
    """Topics of a configured list with the documents that have their terms (GRA9, JN15)."""
    topics = {"licences": ["license", "copyright"], "insults": ["idiot", "moron"]}
    links = graph.topic_links(documents, "doc_id", "text", topics)
    return links.groupBy("topic").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# ---- gates ------------------------------------------------------------------------------------------------


@query(
    "benchmark",
    "documents",
    sql="""WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g')) AS q FROM benchmark), t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g')) AS t FROM documents)
    SELECT item_id, doc_id FROM q JOIN t ON contains(' ' || t || ' ', ' ' || q || ' ') WHERE len(string_split(q, ' ')) >= 6""",
)
def quote_verbatim(benchmark, documents):
    """Quotes that a source holds word for word (DQ2, DQ12, STR3)."""
    return gates.verbatim(benchmark, documents, "item_id", "text", "doc_id", "text")


@query(
    "events",
    sql="""WITH s AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS s, event_type FROM events),
    h AS (SELECT event_id, (SELECT count(*) FROM s b WHERE b.user_id = a.user_id AND b.s > a.s - 3600 AND b.s <= a.s) - 1 AS hits FROM s a)
    SELECT event_id, hits::BIGINT AS hits FROM h WHERE hits >= 2""",
)
def rate_limit_hits(events):
    """Rows with as many of the same sender in the hour before as the limit (DQ18, STM7)."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return gates.previous_hits(events, "user_id", seconds, 3600).where("hits >= 2").select("event_id", "hits")


@query(
    "events",
    sql="""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, max(ts) AS last, date_diff('day', max(ts)::DATE, any_value(now)::DATE)::INT AS age_days,
    date_diff('day', max(ts)::DATE, any_value(now)::DATE) > 14 AS stale FROM events, n GROUP BY 1""",
)
def freshness_by_type(events):
    """How old the newest row of each kind is (DQ13)."""
    return gates.freshness(events, "event_type", "ts", 14)


@query(
    "events",
    sql="""SELECT event_id, user_id FROM (SELECT *, max(epoch(ts)) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id) AS last FROM events) WHERE epoch(ts) > last + 180""",
)
def marks_out_of_range(events):
    """Marks after the end of what they refer to (DQ3)."""
    timed = events.select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return gates.out_of_range(timed, timed.where("event_type = 'view'").withColumnRenamed("at", "end"), "user_id", "at", "end").select("event_id", "user_id")


@query(
    "events",
    sql="""WITH RECURSIVE n AS (SELECT event_type, user_id, epoch(date_trunc('second', ts))::DOUBLE AS "at", row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch(date_trunc('second', ts))) AS i FROM events),
    r AS (SELECT *, "at" AS prev, TRUE AS sent FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.user_id, n."at", n.i, CASE WHEN n."at" - prev >= 86400 THEN n."at" ELSE prev END, n."at" - prev >= 86400
    FROM r JOIN n ON n.event_type = r.event_type AND n.user_id = r.user_id AND n.i = r.i + 1) SELECT event_type, user_id, "at", sent FROM r""",
)
def alert_cooldown(events):
    """Alerts sent unless one was sent not long before (DQ20)."""
    timed = events.select("event_type", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return gates.suppressed(timed, ["event_type", "user_id"], "at", 86400.0)


@query(
    "orders",
    "lineitem",
    sql="""SELECT o_orderkey, n::BIGINT AS n, refs::BIGINT AS refs FROM (SELECT o_orderkey, o_orderkey % 7 AS refs FROM orders) LEFT JOIN
    (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE refs > coalesce(n, 0) + 1""",
)
def incomplete_packets(orders, lineitem):
    """Rows that refer to more parts than are stored (DQ16)."""
    stored = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    refs = orders.select("o_orderkey", (F.col("o_orderkey") % 7).alias("refs"))
    return refs.join(stored, "o_orderkey", "left").where(F.col("refs") > F.coalesce("n", F.lit(0)) + 1).select("o_orderkey", "n", "refs")


_CLAIM = "CASE k % 4 WHEN 0 THEN total WHEN 1 THEN (least_ * 201 + 100) // 200 WHEN 2 THEN 2 * least_ + 7777 ELSE total + 50000 END"


@query(
    "lineitem",
    sql=f"""WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey AS k, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c) AS i FROM v),
    q AS (SELECT k, {_CLAIM} AS claim FROM (SELECT k, sum(c)::BIGINT AS total, min(c) AS least_ FROM v GROUP BY 1)),
    r AS (SELECT k, 0::BIGINT AS i, 0 AS parts, 0::BIGINT AS s FROM q UNION SELECT r.k, n.i, parts + take, s + take * c FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1 JOIN q ON q.k = r.k, (VALUES (0), (1)) t(take)
    WHERE parts + take <= 6 AND s + take * c <= claim + 1)
    SELECT k AS l_orderkey, claim / 100.0 AS claim, EXISTS (SELECT 1 FROM r WHERE r.k = q.k AND parts >= 2 AND abs(s - claim) <= 1)
    OR EXISTS (SELECT 1 FROM v WHERE v.k = q.k AND abs(c / 100.0 - claim / 100.0) / greatest(claim / 100.0, 1.0) <= 0.01) AS backed FROM q""",
)
def figures_backed(lineitem):
    """Dollar figures of one text that those of another back: exactly, within one percent, or added up (DQ7, MTH5, MTH6, MTH7)."""
    cents = lineitem.select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(c / 100.0, 2))
    k, total, least = F.col("l_orderkey"), F.sum_distinct("c"), F.min("c")
    claim = F.when(k % 4 == 0, total).when(k % 4 == 1, F.call_function("div", least * 201 + 100, F.lit(200))).when(k % 4 == 2, 2 * least + 7777).otherwise(total + 50000)
    said = F.array_join(F.collect_list(F.concat(F.lit("we paid "), dollars(F.col("c")))), ", ")
    texts = cents.groupBy("l_orderkey").agg(said.alias("source"), F.concat(F.lit("It cost "), dollars(claim)).alias("article"))
    read = texts.select("l_orderkey", gates.money_in(F.col("article")).alias("claims"), gates.money_in(F.col("source")).alias("sources"))
    return gates.figures_backed(read, "claims", "sources").select("l_orderkey", "claim", "backed")


@query(
    "conversations",
    sql=r"""SELECT conv_id, turn, trim(regexp_replace('& ' || text || ' x', '\s+', ' ', 'g'))[1:2000] AS text FROM conversations""",
)
def sanitised_input(conversations):
    """User input trimmed, without tags and control characters, cut to a length (DQ19, STR20)."""
    marked = conversations.withColumn("text", F.concat(F.lit(" <b>&amp;</b>\x01 "), F.regexp_replace("text", "[<>&]", ""), F.lit("<br/>x \x07")))
    conversations = marked
    plain = text.strip_tags(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return conversations.select("conv_id", "turn", F.substring(F.trim(plain), 1, 2000).alias("text"))


@query("documents", sql=r"""SELECT doc_id, md5(text)[1:12] AS short_id, length(text) AS n,
    md5(lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^a-z ]', '', 'gi'))) AS letters_md5 FROM documents""")
def text_identity(documents):
    """A short digest and a normal form of each text (STR5, STR29, ETL10)."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    letters = F.lower(F.regexp_replace(flat, "(?i)[^a-z ]", ""))
    return documents.select("doc_id", text.short_id(F.col("text")).alias("short_id"), F.length("text").alias("n"), F.md5(letters).alias("letters_md5"))


@query("part")
def fuzzy_names(part):
    """For each mistyped name the most similar known one (JN16, STR25, AGG16)."""
    known = part.select("p_name").distinct()
    typed = known.select(F.regexp_replace("p_name", "e", "ee").alias("typed"))
    scored = names.similar_pairs(typed, known, "typed", "p_name", 0.82)
    return scored.groupBy("typed").agg(F.max(F.struct("score", "p_name")).getField("p_name").alias("best"))
