"""Queries that write rows of the tables in the forms of files, pages and transcripts, and read them back."""

from pyspark.sql import functions as F

from ledgerlark.functions import dates, nested, text
from ledgerlark.operators import chunking, filters, gates, windows
from ledgerlark.sources import files, web

from .registry import query

C = F.col


def _said(conversations):
    """Turns with short utterances among them."""
    k = C("turn") % 6
    short = [(0, "Seconded."), (1, " So moved"), (2, "A player"), (3, "Opposed! "), (4, " ")]
    said = C("text")
    for i, words in short:
        said = F.when(k == i, words).otherwise(said)
    return conversations.select("conv_id", "turn", said.alias("text"))


_SAID = """(SELECT conv_id, turn, trim(CASE turn % 6 WHEN 0 THEN 'Seconded.' WHEN 1 THEN ' So moved' WHEN 2 THEN 'A player' WHEN 3 THEN 'Opposed! ' WHEN 4 THEN ' ' ELSE text END) AS t
    FROM conversations)"""


@query(
    "conversations",
    sql=rf"""SELECT conv_id, turn FROM {_SAID} WHERE t <> '' AND (length(t) >= 30 OR regexp_matches(t, '(?i)\b(aye|nay|second(ed)?|so moved|opposed?|all in favor|abstain(ed)?|motion carries)\b'))""",
)
def utterances_that_count(conversations):
    """Utterances long enough, or short ones that say a vote in whole words (FLT13)."""
    return filters.spoken(_said(conversations), "text").select("conv_id", "turn")


@query(
    "conversations",
    sql=rf"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM {_SAID}
    WHERE t <> '' AND (length(t) >= 30 OR regexp_matches(t, '(?i)(aye|nay|second|so moved|opposed|all in favor|abstain|motion carries)'))""",
)
def vote_safe_chunks(conversations):
    """Each utterance that counts as a chunk, votes in any part of a word counted (CHK8)."""
    kept = filters.spoken(_said(conversations), "text", whole_words=False)
    place = windows.order_window(["conv_id"], ["turn"])
    return kept.select("conv_id", "turn", (F.row_number().over(place) - 1).alias("chunk_index"))


@query(
    "conversations",
    sql="""WITH c AS (SELECT conv_id, turn, turn // 3 % 2 AS s, text FROM conversations), w AS (SELECT *, lead(s) OVER o AS s1, lead(s, 2) OVER o AS s2,
    lead(text) OVER o AS t1, lead(text, 2) OVER o AS t2 FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 1 AS length, text AS joined FROM w UNION ALL SELECT conv_id, turn, 2, text || ' ' || t1 FROM w WHERE s1 = s
    UNION ALL SELECT conv_id, turn, 3, text || ' ' || t1 || ' ' || t2 FROM w WHERE s1 = s AND s2 = s""",
)
def joined_turns(conversations):
    """Each row's text with those of one and two more rows of the same speaker (WIN9)."""
    told = conversations.withColumn("speaker", F.floor(C("turn") / 3) % 2)
    return windows.joined_runs(told, "conv_id", "turn", "speaker", "text")


@query(
    "conversations",
    sql="""WITH RECURSIVE n AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text <> ''),
    r AS (SELECT conv_id, i, turn AS start, text || ' ' AS c, 0 AS k FROM n WHERE i = 1
    UNION ALL SELECT r.conv_id, n.i, CASE WHEN length(c) + length(text) > 800 THEN n.turn ELSE r.start END,
    CASE WHEN length(c) + length(text) > 800 THEN text || ' ' ELSE c || text || ' ' END, k + (length(c) + length(text) > 800)::INT FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)
    SELECT conv_id, k AS chunk_index, arg_max(start, i)::DOUBLE AS start, trim(arg_max(c, i)) AS content, length(arg_max(c, i)) AS chars FROM r GROUP BY 1, 2""",
)
def caption_chunks(conversations):
    """Utterances gathered to chunks of about 800 characters (CHK6)."""
    timed = conversations.select("conv_id", "turn", C("turn").cast("double").alias("start"), (C("turn") + 1.0).alias("end"), "text")
    return chunking.accumulated(timed, "conv_id", 800).select("conv_id", "chunk_index", "start", "content", "chars")


@query(
    "documents",
    sql=r"""WITH t AS (SELECT doc_id, 'Accident reported near ' || (doc_id % 90 + 1) || ' Old Post Road on March ' || (doc_id % 28 + 1) || ', 2024 by the license desk' || chr(10) || text AS text FROM documents),
    p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 30)[1:20] AS p FROM t),
    r AS (SELECT doc_id, unnest(p) AS content, unnest(range(0, len(p)))::INT AS place FROM p)
    SELECT doc_id, place, CASE WHEN content ILIKE '%license%' THEN 'legal' WHEN content ILIKE '%the %' THEN 'english' ELSE 'other' END AS kind,
    CASE WHEN place = 0 THEN (doc_id % 90 + 1) || ' Old Post Road' ELSE '' END AS street, CASE WHEN place = 0 THEN 'March ' || (doc_id % 28 + 1) || ', 2024' ELSE '' END AS day FROM r""",
)
def incident_list(documents):
    """Paragraphs as incidents of a kind, with street and day (EXT12, STR28)."""
    number = lambda n: (C("doc_id") % n + 1).cast("string")
    first = F.concat(F.lit("Accident reported near "), number(90), F.lit(" Old Post Road on March "), number(28), F.lit(", 2024 by the license desk\n"))
    told = documents.withColumn("text", F.concat(first, "text"))
    return chunking.incidents(told, "doc_id", "text", [("legal", ["license"]), ("english", ["the "])])


@query(
    "orders",
    sql="""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS approved, o_orderdate::DATE - 40 AS met FROM orders)
    SELECT o_orderkey, CASE WHEN month(met) > month(approved) OR year(met) = year(approved) THEN met END AS met FROM d""",
)
def minutes_dates(orders):
    """Dates of minutes without a year, by the date that they were approved on (DT5)."""
    approved = C("o_orderdate").cast("date")
    met = F.date_sub(approved, 40)
    return orders.select("o_orderkey", dates.with_inferred_year(F.month(met), F.dayofmonth(met), approved).alias("met"))


@query(
    "orders",
    sql="""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'the budget of ' || clerk WHEN 1 THEN 'sign for ' || clerk WHEN 2 THEN '12 Mill Road (' || clerk || ')'
    WHEN 3 THEN 'seeking front yard variance' WHEN 4 THEN 'Site plan of ' || clerk WHEN 5 THEN 'Hearing on ' || clerk WHEN 6 THEN rpad('x ' || clerk || ' ', 117, 'y') || '...' 
    ELSE 'Approve ' || clerk END AS title FROM (SELECT o_orderkey, 'Customer ' || o_custkey AS clerk FROM orders)""",
)
def agenda_titles(orders):
    """What agenda items are about, legal phrasing left out (STR24)."""
    k, clerk = C("o_orderkey") % 8, F.concat(F.lit("Customer "), C("o_custkey").cast("string"))
    forms = [
        ("Consider adopting the budget of ", ""),
        ("consider authorizing the Village Manager to sign for ", ""),
        (None, ", owner --- 12 Mill Road"),
        ("Request for a front yard variance from Village Zoning Code for ", ""),
        ("Site plan of ", " Section 12.34 Block 5 Lot 6"),
        ("Hearing on ", " — Located in a residence district"),
    ]
    title = F.when(k == 6, F.rpad(F.concat(F.lit("x "), clerk, F.lit(" ")), 150, "y")).otherwise(F.concat(F.lit("Approve "), clerk))
    for i, (head, tail) in enumerate(forms):
        title = F.when(k == i, F.concat(F.lit(head or ""), clerk, F.lit(tail))).otherwise(title)
    return orders.select("o_orderkey", text.clean_agenda_title(title).alias("title"))


@query(
    "part",
    sql="""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'so it is ' || p_name WHEN 1 THEN 'you know when ' || p_name || ' came' ELSE 'it was fine ' || p_name END AS said FROM part""",
)
def without_fillers(part):
    """Speech without fillers (STR16)."""
    k, name = C("p_partkey") % 3, C("p_name")
    said = (
        F.when(k == 0, F.concat(F.lit("Um, so uh it  is "), name))
        .when(k == 1, F.concat(F.lit("you know when "), name, F.lit(" came")))
        .otherwise(F.concat(F.lit("it was, you know, fine "), name))
    )
    return part.select("p_partkey", text.without_fillers(said, set_off=True).alias("said"))


@query(
    "part",
    sql="""WITH w AS (SELECT p_partkey, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) AS a, upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS b FROM part)
    SELECT p_partkey, CASE WHEN a = 'Green' OR b = 'Green' THEN '' ELSE a || ' ' || b END AS people FROM w WHERE length(a) > 2 AND length(b) > 2""",
)
def people_named(part):
    """Names of people in a text: not sentence begins, headings or words that are no names (STR27)."""
    words = F.split("p_name", " ")
    pair = F.concat_ws(" ", F.initcap(words[0]), F.initcap(words[1]))
    told = F.concat(F.lit("Today Board met. Seen There was "), pair, F.lit(" speaking of Big Old Barn things\nHeading Here\n- Item Text is"))
    rows = part.where((F.length(words[0]) > 2) & (F.length(words[1]) > 2))
    return rows.select("p_partkey", F.array_join(text.people_in(told, ("Green",)), ",").alias("people"))


@query(
    "customer",
    sql=r"""SELECT c_custkey, 'Customer' AS base, c_custkey % 3 = 0 AS generic, TRUE AS has_word, c_custkey % 2 = 0 AS has_part FROM customer""",
)
def name_helpers(customer):
    """A name's base, whether a speaker has no name, and whether a text has a word (EXT34)."""
    token = F.concat(F.regexp_extract("c_name", r"^(\w+)#", 1), F.lit("-Smith’s"))
    label = F.when(C("c_custkey") % 3 == 0, F.concat(F.lit("Speaker "), C("c_custkey").cast("string"))).otherwise(C("c_name"))
    noted = F.when(C("c_custkey") % 2 == 0, "said (a+b.") .otherwise("said aab.")
    return customer.select(
        "c_custkey",
        text.base_token(token).alias("base"),
        text.is_generic_speaker(label).alias("generic"),
        text.has_word(C("c_name"), F.regexp_extract("c_name", r"^(\w+)#", 1)).alias("has_word"),
        text.has_word(noted, F.lit("a+b")).alias("has_part"),
    )


@query(
    "orders",
    "lineitem",
    sql="SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS ids, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1",
)
def ids_in_lists(orders, lineitem):
    """Lists of ids parted by commas, with blanks, empty places and repeats, as sets of numbers (ARR2)."""
    listed = lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(C("l_partkey").cast("string")), ", ,").alias("ids"))
    found = F.sort_array(text.ids_of(F.concat(C("ids"), F.lit(","), C("ids"))))
    return listed.select("l_orderkey", found.alias("ids"), F.size(found).cast("bigint").alias("n"))


@query(
    "lineitem",
    sql="""SELECT l_orderkey, l_linenumber, round_even((l_quantity * 9 / 5 + 32)::DOUBLE, 1) AS fahrenheit, round_even(l_quantity * 0.621371::DOUBLE, 1) AS mph FROM lineitem""",
)
def converted_readings(lineitem):
    """Readings in other units, halves rounded to even (MTH3)."""
    c = C("l_quantity").cast("double")
    return lineitem.select("l_orderkey", "l_linenumber", dates.rounded(c * 9 / 5 + 32, 1).alias("fahrenheit"), dates.rounded(c * 0.621371, 1).alias("mph"))


@query(
    "documents",
    sql=r"""SELECT doc_id, lower(regexp_replace(source, '[^A-Za-z0-9_ ]', '', 'g')) || ' of the day' AS plain, lang || ' day' AS said FROM documents""",
)
def plain_and_unfluttered(documents):
    """Texts without punctuation, and with words said twice said once (STR4, STR7)."""
    noted = F.concat("source", F.lit("! -  of, the  Day."))
    said = F.concat("lang", F.lit(" "), C("lang"), F.lit(" day day"))
    return documents.select("doc_id", text.no_punctuation(noted).alias("plain"), text.deflutter(said).alias("said"))


@query(
    "documents",
    sql=r"""WITH l0 AS (SELECT doc_id, string_split('Page 1 of 9' || chr(10) || text || chr(10) || ' 12 ' || chr(10) || chr(10) || ' ' || chr(10) || 'end', chr(10)) AS l FROM documents),
    l AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM l0), b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
    often AS (SELECT bare FROM (SELECT DISTINCT doc_id, bare FROM b WHERE length(bare) >= 12) GROUP BY 1 HAVING count(*) >= 5),
    m AS (SELECT *, regexp_matches(lower(bare), '^(page\s+\d+(\s+of\s+\d+)?|\d+)$') OR bare IN (FROM often) AS gone FROM b),
    k AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m WHERE NOT gone)
    SELECT doc_id, n AS n_dropped, md5(trim(coalesce(t, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS digest FROM (SELECT doc_id, count_if(gone) AS n FROM m GROUP BY 1)
    LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM k WHERE NOT (bare = '' AND coalesce(before = '', false)) GROUP BY 1) USING (doc_id)""",
)
def cleaned_packets(documents):
    """Texts without page numbers and the lines that many of them share (STR22, AGG17)."""
    told = documents.select("doc_id", F.concat(F.lit("Page 1 of 9\n"), "text", F.lit("\n 12 \n\n \nend")).alias("text"))
    bare = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    often = filters.lines_in_many(told.select("doc_id", F.array_join(bare, "\n").alias("text")), "doc_id", "text", 5, 12)
    kept = filters.without_lines(told, "doc_id", "text", often, "line")
    return kept.select("doc_id", "n_dropped", F.md5("text").alias("digest"))


@query(
    "nation",
    sql="""SELECT n_nationkey, 'Hand written by ' || n_name || ' in note … word' AS manuscript, 'A' || chr(10) || n_name || chr(10) || chr(10) || 'B' AS page,
    '[0:01] A: ' || n_name || ' more' || chr(10) || '[0:05] B: x' AS blocks FROM nation""",
)
def cleaned_scans(nation):
    """Scanned texts: parted words, margin notes, page numbers, and lines that go on (STR21, STR22, STR23)."""
    name = C("n_name")
    manuscript = F.concat(F.lit("Hand writ-\n ten by "), name, F.lit(" in [marg: note] [illegible] [?word]"))
    page = F.concat(F.lit("A\nPage 3 of 9\n"), name, F.lit("\n12\n\n\n\nB"))
    blocks = F.concat(F.lit("[0:01] A: "), name, F.lit("\nmore\n[0:05] B: x"))
    return nation.select(
        "n_nationkey",
        text.clean_manuscript(manuscript).alias("manuscript"),
        text.clean_page_lines(page).alias("page"),
        text.join_continuations(blocks).alias("blocks"),
    )


@query(
    "region",
    "nation",
    sql="SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
)
def names_in_json(region, nation):
    """Names of JSON lists whose items are texts or objects (JSN2)."""
    item = F.when(C("n_nationkey") % 2 == 0, F.to_json(F.struct(C("n_name").alias("name")))).otherwise(F.concat(F.lit('"'), C("n_name"), F.lit('"')))
    lists = nation.groupBy("n_regionkey").agg(F.concat(F.lit('{"l": ['), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit(', {"id": 1}]}')).alias("j"))
    return lists.select("n_regionkey", F.array_join(F.array_sort(nested.names_of(C("j"), "$.l")), ",").alias("names"))


@query(
    "conversations",
    sql="""SELECT conv_id, turn, k.i AS place, (turn * 10 + k.i)::INT AS seconds, ' part ' || k.i || ' ' AS following FROM conversations, (VALUES (1), (2)) k(i)""",
)
def quote_markers(conversations):
    """The quote markers of a text with what follows each (DQ1)."""
    mark = lambda i: F.concat(F.lit("{{quote:"), (C("turn") * 10 + i).cast("string"), F.lit(f"}}}} part {i} "))
    told = conversations.withColumn("said", F.concat(F.lit("before "), mark(1), mark(2)))
    keyed = told.withColumn("key", F.struct("conv_id", "turn"))
    return gates.quotes_in(keyed, "key", "said").select("key.conv_id", "key.turn", "place", "seconds", "following")


@query(
    "conversations",
    sql="""SELECT conv_id, turn - 1 AS place, (turn * 2 + 0.5)::DOUBLE AS start, (turn * 2 + 2)::DOUBLE AS "end", role || ' said x' AS text FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations)""",
)
def subtitles(conversations):
    """Turns written as a subtitle file and read back (SRC8)."""
    place = F.row_number().over(windows.order_window(["conv_id"], ["turn"]))
    stamp = lambda ms: F.concat(
        F.lpad(F.floor(ms / 3600000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 60000) % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )
    at = conversations.select("conv_id", "role", place.alias("n"))
    block = F.concat(C("n").cast("string"), F.lit("\n"), stamp(C("n") * 2000 + 500), F.lit(" --> "), stamp(C("n") * 2000 + 2000), F.lit("\n<i>"), "role", F.lit("</i>\n said  x\n"))
    whole = at.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("bs"))
    read = whole.select("conv_id", F.posexplode(files.captions(F.array_join(F.transform("bs", lambda b: b["b"]), "\n"))).alias("place", "c"))
    return read.select("conv_id", "place", "c.start", "c.end", "c.text")


@query(
    "nation",
    sql="SELECT n_nationkey, n_name AS title, 'r' || n_regionkey AS region, 'Body of ' || n_name AS body FROM nation",
)
def front_matter(nation):
    """Fields before a text, and the text (SRC5)."""
    whole = F.concat(F.lit("---\ntitle: '"), "n_name", F.lit("'\nregion: r"), C("n_regionkey").cast("string"), F.lit("\n---\nBody of "), "n_name")
    read = nation.select("n_nationkey", files.frontmatter(whole).alias("f"))
    return read.select("n_nationkey", C("f.fields")["title"].alias("title"), C("f.fields")["region"].alias("region"), "f.body")


@query(
    "region",
    "nation",
    sql="""SELECT r_regionkey, r_name AS title, 'of the world' AS subtitle, r_name || '.jpg' AS photo, list_sort(list(n_name)) AS sources, 'Text of ' || r_name || '.' AS body, 2 + len(string_split(r_name, ' ')) AS word_count
    FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def stories(region, nation):
    """Marked-up stories: heading, emphasised line, photo, sources and text (SRC6)."""
    links = nation.groupBy(C("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    name = C("r_name")
    listed = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x)), "\n")
    whole = F.concat(F.lit("# "), name, F.lit("\n*of the world*\n![A photo]("), name, F.lit(".jpg)\n\nText of "), name, F.lit(".\n\n## Sources\n"), listed)
    told = region.join(links, "r_regionkey").select("r_regionkey", whole.alias("t"))
    return files.story(told, "r_regionkey", "t")


@query(
    "nation",
    sql="""SELECT n_regionkey, CASE WHEN count(*) FILTER (WHERE n_nationkey % 2 = 0) > 0 THEN 'r' || n_regionkey || '_long' ELSE 'r' || n_regionkey END AS name FROM nation GROUP BY 1""",
)
def preferred_variants(nation):
    """Of two files of a name the long one (SRC7)."""
    stem = F.concat(F.lit("r"), C("n_regionkey").cast("string"))
    named = nation.select("n_regionkey", F.when(C("n_nationkey") % 2 == 0, F.concat(stem, F.lit("_long"))).otherwise(stem).alias("name"))
    return files.prefer_long(named, "name").select("n_regionkey", "name")


@query(
    "region",
    "nation",
    sql="""SELECT n_regionkey, n_name AS title, 'http://x/' || n_nationkey AS link, 'About ' || n_name || ' & more' AS description, 'Mon, 01 Jan 2024 00:00:00 +0000' AS published, n_nationkey % 2 = 0 AS near FROM nation""",
)
def feed_entries(region, nation):
    """Entries of a feed, and whether they are about a place (SRC10)."""
    place = F.when(C("n_nationkey") % 2 == 0, " in Croft").otherwise(" in Crofton")
    item = F.concat(
        F.lit("<item><title><![CDATA["), "n_name", F.lit("]]></title><link>http://x/"), C("n_nationkey").cast("string"), F.lit("</link><description>About "),
        "n_name", F.lit(" &amp; more"), F.lit("</description><category>"), place, F.lit("</category><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item>"),
    )
    feeds = nation.groupBy("n_regionkey").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("feed"))
    read = feeds.select("n_regionkey", F.explode(web.feed_items(C("feed"))).alias("e")).select("n_regionkey", "e.*")
    number = F.regexp_extract("link", r"(\d+)$", 1).cast("int")
    about = F.concat(C("description"), F.when(number % 2 == 0, " in Croft").otherwise(" in Crofton"))
    return read.withColumn("near", web.relevant(C("title"), about, ["Croft"]))


@query(
    "orders",
    sql="""SELECT o_orderkey, (o_orderkey % 40)::INT AS number, (2024 + o_orderkey % 3)::INT AS year, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2025-03-04' END AS filed FROM orders WHERE o_orderkey % 3 > 0""",
)
def filed_laws(orders):
    """Number, year and filing date in the names of law files, those of 2025 on (SRC17)."""
    name = F.concat(
        F.lit("Local_Law_No_"), (C("o_orderkey") % 40).cast("string"), F.lit("_of_"), (2024 + C("o_orderkey") % 3).cast("string"),
        F.when(C("o_orderkey") % 2 == 0, " filed 2025-03-04.pdf").otherwise(".pdf"),
    )
    law = files.filed_law(name, F.to_date(F.lit("2025-06-01")))
    return orders.select("o_orderkey", law.alias("l")).where("l is not null").select("o_orderkey", "l.*")


@query(
    "region",
    "nation",
    sql="""SELECT n_regionkey, 'March ' || (n_nationkey % 28 + 1) AS day, 'Concert in ' || n_name AS title FROM nation""",
)
def calendar_entries(region, nation):
    """Days and titles of a calendar's lines (EXT13)."""
    line = F.concat(F.lit("  March "), (C("n_nationkey") % 28 + 1).cast("string"), F.lit(" – Concert in "), "n_name")
    pages = nation.groupBy("n_regionkey").agg(F.concat(F.lit("Events\n"), F.array_join(F.collect_list(line), "\nno date: here\n")).alias("t"))
    return pages.select("n_regionkey", F.explode(web.calendar_lines(C("t"))).alias("e")).select("n_regionkey", "e.day", "e.title")


@query(
    "nation",
    sql="""SELECT n_nationkey, p.place, CASE p.place WHEN 0 THEN '§ 12-3 ' || n_name || ' defined as follows' WHEN 1 THEN 'A. The first rule of all' WHEN 2 THEN 'Fee    $' || n_nationkey ELSE 'Closing words' END AS block
    FROM nation, (VALUES (0), (1), (2), (3)) p(place)""",
)
def law_blocks(nation):
    """A law's lines joined to blocks, table lines kept (EXT22)."""
    whole = F.concat(F.lit("§ 12-3 "), "n_name", F.lit(" de-\nfined as\n  follows\nA. The first\nrule of all\nFee    $"), C("n_nationkey").cast("string"), F.lit("\nClosing\nwords\n\n"))
    return nation.select("n_nationkey", F.posexplode(text.reflowed(whole)).alias("place", "block"))


@query(
    "documents",
    sql="SELECT 'd' || doc_id AS stem, md5(text) AS digest FROM documents WHERE length(text) >= 49",
)
def text_folder(documents):
    """A folder of texts, many to a file, written from the table (each with a line end), read recursively (SRC3)."""
    spark = documents.sparkSession
    folder = files.write_texts(documents.select(F.concat(F.lit("d"), C("doc_id").cast("string")).alias("stem"), F.coalesce("text", F.lit("")).alias("text")))
    return files.text_files(spark, folder, packed=True).select("stem", F.md5(F.substring("text", F.lit(1), F.length("text") - 1)).alias("digest"))


@query(
    "conversations",
    "orders",
    sql="""WITH m AS (SELECT o_orderkey AS k, o_orderpriority AS committee, o_orderdate::DATE AS d, CASE o_orderkey % 3 WHEN 0 THEN 'Present: ' || c.w ELSE '' END AS minutes, o_orderkey
    FROM orders, (SELECT 'Li and Wu' AS w) c), n AS (SELECT k, committee, d, minutes, CASE k % 5 WHEN 0 THEN 'Ann Li' WHEN 1 THEN 'Bo Chu' WHEN 2 THEN 'Cy Wu' WHEN 3 THEN 'Di Ode' ELSE 'Clerk' END AS name FROM m),
    a AS (SELECT *, split_part(name, ' ', 2) AS s FROM n WHERE name <> 'Clerk'),
    o AS (SELECT *, (minutes <> '' AND s IN ('Li', 'Wu')) OR (s = 'Ode' AND k % 2 = 0) AS own FROM a)
    SELECT k, name, CASE WHEN minutes <> '' THEN 'attendance-mismatch' ELSE 'unverifiable-name' END AS kind FROM o WHERE NOT own AND NOT (minutes = '' AND (name = 'Bo Chu' AND k % 7 = 0 AND FALSE
    OR s IN ('Li', 'Wu') AND EXISTS (SELECT 1 FROM m x WHERE x.committee = o.committee AND x.minutes <> '' AND x.d BETWEEN o.d - 120 AND o.d)))""",
)
def uncorroborated_labels(conversations, orders):
    """Speaker labels that neither the meeting's records nor those of the 120 days before bear out (DQ8)."""
    k = C("o_orderkey")
    minutes = F.when(k % 3 == 0, "Present: Li and Wu").otherwise("")
    meetings = orders.select(
        k.alias("k"), C("o_orderpriority").alias("committee"), C("o_orderdate").cast("date").alias("date"), minutes.alias("minutes"), F.lit("Roll call").alias("agenda")
    )
    name = F.when(k % 5 == 0, "Ann Li").when(k % 5 == 1, "Bo Chu").when(k % 5 == 2, "Cy Wu").when(k % 5 == 3, "Di Ode").otherwise("Clerk")
    spoken = orders.select(k.alias("k"), F.when(k % 2 == 0, "an Ode, they said").otherwise("nothing").alias("text"))
    verified = conversations.select(F.concat("role", F.lit(" x")).alias("name"))
    return gates.corroborated_labels(orders.select(k.alias("k"), name.alias("name")), meetings, spoken, verified, "k")
