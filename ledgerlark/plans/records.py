"""Queries on nested records, pages, dates and incremental runs."""

from pyspark.sql import functions as F

from ledgerlark.functions import dates, nested, text
from ledgerlark.sources import dom, files, web
from ledgerlark.streaming import incremental

from .registry import query


@query(
    "events",
    sql="""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""",
)
def json_props_extract(events):
    """Values of JSON text with defaults (JSN1, JSN3, SRC11)."""
    return events.select(
        "event_id", nested.json_value(F.col("props"), "$.k", "0").alias("k"), nested.json_value(F.col("props"), "$.missing", "none").alias("missing")
    )


@query(
    "events",
    sql="""SELECT user_id, arg_max(TRY_CAST(json_extract_string(props, '$.k') AS INT), (ts, event_id)) AS last_k, count(*) AS readings FROM events GROUP BY 1""",
)
def last_reading(events):
    """The last reading of each gauge (SRC11, ARR3)."""
    k = nested.json_value(F.col("props"), "$.k").try_cast("int")
    rows = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", k.alias("k"))).alias("l"), F.count("*").alias("readings"))
    return rows.select("user_id", F.col("l.k").alias("last_k"), "readings")


@query("conversations", sql="SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS named FROM conversations GROUP BY 1")
def nested_transcripts(conversations):
    """Turns nested to transcripts with a speaker map, and read back as utterances (SRC2, ETL1, JSN4)."""
    u = F.struct(
        F.concat(F.lit("Speaker "), F.when(F.col("role") == "assistant", "1").otherwise("0")).alias("speaker"),
        "text",
        F.col("turn").cast("double").alias("start"),
        (F.col("turn") + 1.0).alias("end"),
    )
    whole = conversations.groupBy(F.col("conv_id").cast("string").alias("event_id")).agg(F.to_json(F.array_sort(F.collect_list(u))).alias("json"))
    parsed = whole.select("event_id", F.from_json("json", f"array<{files.UTTERANCE}>").alias("utterances"), F.create_map(F.lit("1"), F.lit("Clerk")).alias("speaker_map"))
    rows = files.utterances(parsed).groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("speaker") == "Clerk").alias("named"))
    return rows.select(F.col("event_id").cast("bigint").alias("conv_id"), "n", "named")


@query("pages", sql="""SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
    len(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>.*?</a>')) AS links FROM pages""".replace("\\\\", "\\"))
def html_title_links(pages):
    """Title and number of links of each page (SRC9)."""
    return pages.select("page_id", web.title_of(F.col("html")).alias("title"), F.size(web.links_of(F.col("html"))).cast("bigint").alias("links"))


@query(
    "pages",
    sql=r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>.*?</a>'), 1) AS place FROM pages),
    l AS (SELECT page_id, place, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a),
    o AS (SELECT page_id, href, min(place) AS place, arg_min(label, place) AS label FROM l WHERE length(label) >= 5 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS n FROM o)
    SELECT md5('pages|' || label || '|' || href)[1:12] AS id, label AS title, href AS url, label AS summary FROM r WHERE n <= 30""".replace("\\\\", "\\"),
)
def link_listing(pages):
    """The first links of each page with whole addresses, each once (SRC9, EXT16, ETL10)."""
    rows = web.listing(pages, "page_id", "url", "html")
    return web.scraped(rows, "pages", "listing", "label", "href", "label").select("id", "title", "url", "summary")


#: News rows of several systems; of this kind of page the menu's entries are what is left to fall back on.
NEWS = dom.Listing(
    rows=(".view-content .views-row, .news-item, article.node", "main li", "nav > ul li"),
    title=("h2 a, h3 a, .title a", "a"),
    date=("time, [class*=date]",),
    summary=(".summary, p",),
)


@query(
    "pages",
    sql=r"""WITH i AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), '<li>.*?</li>')[1:30] AS i FROM pages),
    r AS (SELECT page_id, url, unnest(i) AS li, unnest(range(0, len(i)))::INT AS place FROM i),
    t AS (SELECT page_id, place, replace(replace(regexp_replace(li, '<[^>]+>', '', 'g'), '&quot;', '"'), '&amp;', '&') AS title, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(li, 'href="([^"]*)"', 1) AS url FROM r)
    SELECT page_id, place_ AS place, title, url, NULL::VARCHAR AS date, '' AS summary FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place)::INT - 1 AS place_ FROM t WHERE length(title) >= 5)""",
)
def selected_rows(pages):
    """The rows of each page's listing by the first list of selectors that finds any (SRC9)."""
    return dom.listed(pages, "page_id", "url", "html", NEWS)


@query("pages", sql=r"""SELECT page_id, 0 AS place, trim(regexp_replace(replace(replace(regexp_extract(html, '<article>.*?<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""".replace("\\\\", "\\"))
def selected_headlines(pages):
    """The headline of each page's article, found by its place in the page, however short, and empty without one; of references
    only &amp; and &quot; are decoded, and a part of one that was cut off stays as it is (SRC9)."""
    html = F.regexp_replace("html", "&(?!(?:amp|quot);)", "&amp;")
    found = F.get(dom.rows_of(html, dom.Listing(("article",), ("h1",), least_chars=1)), 0)
    title = F.when(F.col("html").isNotNull(), F.coalesce(found["title"], F.lit("")))
    return pages.select("page_id", F.lit(0).alias("place"), title.alias("title"))


@query(
    "pages",
    sql=r"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1)) AS li FROM pages), t AS (SELECT page_id, trim(regexp_replace(regexp_replace(li, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM i)
    SELECT page_id, CASE WHEN length(t) % 2 = 0 THEN 'Item ' || length(t) ELSE '' END AS kind, CASE WHEN length(t) % 2 = 0 THEN t || ' - x' ELSE t END AS title FROM t""".replace("\\\\", "\\"),
)
def agenda_of_pages(pages):
    """List items of each page as agenda items, some of them with a kind before the title (SRC13)."""
    plain = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<li[^>]*>(.*?)</li>"), F.lit(1))).alias("li")).select("page_id", text.strip_tags(F.col("li")).alias("t"))
    kind = F.when(F.length("t") % 2 == 0, F.concat(F.lit("Item "), F.length("t").cast("string"), F.lit(" - "), "t", F.lit(" - x"))).otherwise(F.col("t"))
    lists = plain.groupBy("page_id").agg(F.concat(F.lit("<ul><li class='x'>"), F.array_join(F.collect_list(kind), "</li>\n<LI><b>"), F.lit("</b></li></ul>")).alias("html"))
    return lists.select("page_id", F.explode(web.agenda_items(F.col("html"))).alias("i")).select("page_id", "i.kind", "i.title")


@query(
    "pages",
    sql=r"""WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages),
    d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM t)
    SELECT page_id, 3 AS attendees, 1 AS motions, 2 AS speakers, (29 + len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')))::INT AS word_count FROM d""",
)
def minutes_of_pages(pages):
    """Attendance, motions, speakers and words of minutes that stand before each page (SRC14)."""
    said = "<p>Present: Ann Lee, Bob Ray and Cy Dee; Motion made by Ann Lee, seconded by Bob Ray carried. Cy Dee said no. Ann Lee asked why, Cy Dee noted.</p>"
    m = pages.select("page_id", web.minutes(F.concat(F.lit(said), "html")).alias("m"))
    return m.select("page_id", F.size("m.attendees").alias("attendees"), F.size("m.motions").alias("motions"), F.size("m.speakers").alias("speakers"), "m.word_count")


@query(
    "orders",
    sql="""SELECT o_custkey, o_orderstatus || ' > Order ' || o_orderkey AS path, 'scan' AS name, '/files/' || o_orderkey || '.pdf' AS url, 'pdf' AS kind FROM orders""",
)
def agenda_tree(orders):
    """A tree of items built from orders, flattened with paths and attachments (ARR4, ARR5, ETL8, ETL9, EXT5, EXT10)."""
    leaf = F.struct(
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.array(F.struct(F.lit("scan").alias("name"), F.concat(F.lit("/files/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("url"))).alias("attachments"),
    )
    by_status = orders.groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list(leaf)).alias("children"))
    group = F.struct(F.col("o_orderstatus").alias("title"), "children")
    trees = by_status.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(group))).alias("agenda"))
    tree = nested.flatten_tree(trees, "o_custkey", "agenda", depth=3)
    return nested.attachments_of(tree, "o_custkey")


@query(
    "orders",
    sql="""SELECT o_orderkey, strftime(o_orderdate, '%A, %B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS long_form, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS rfc,
    strftime(o_orderdate, '%Y%m%d') AS compact, (o_orderkey % 20000 // 3600)::INT AS h FROM orders""",
)
def date_forms(orders):
    """Dates in the forms of pages and feeds (DT9, DT10, SRC12)."""
    at = F.col("o_orderdate").cast("timestamp")
    compact = F.date_format(at, "yyyyMMdd")
    back = F.to_date(compact, "yyyyMMdd")
    return orders.select(
        "o_orderkey",
        dates.long_form(back).alias("long_form"),
        dates.rfc_822(at).alias("rfc"),
        compact.alias("compact"),
        F.floor(F.col("o_orderkey") % 20000 / 3600).cast("int").alias("h"),
    )


@query(
    "orders",
    sql="""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_title, CAST(o_orderdate AS DATE) AS from_slashes, CAST(o_orderdate AS DATE) AS parsed FROM orders""",
)
def dates_in_titles(orders):
    """Dates read out of titles of two forms and parsed by the first format that fits (DT3, DT4)."""
    at = F.col("o_orderdate").cast("timestamp")
    spoken = F.concat(F.lit("Board Meeting "), F.date_format(at, "MMMM d, yyyy"))
    slashes = F.concat(F.lit("Meeting of "), F.date_format(at, "M/d/yyyy"), F.lit(" (part 2)"))
    none = F.lit(None).cast("date")
    return orders.select(
        "o_orderkey",
        dates.in_title(spoken, none).alias("from_title"),
        dates.in_title(slashes, none).alias("from_slashes"),
        dates.parsed(F.date_format(at, "MMMM d, yyyy")).cast("date").alias("parsed"),
    )


@query(
    "orders",
    sql="""SELECT o_orderkey, CAST(o_orderdate AS DATE) - 45 AS before, extract(hour FROM ((date_trunc('day', o_orderdate) + INTERVAL 12 HOUR)::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'))::INT - 12 AS shift FROM orders""",
)
def date_shifts(orders):
    """Days before a date, and the hours that local time is off (DT2, DT5, DT8)."""
    day = F.col("o_orderdate").cast("date")
    offset = F.substring(dates.eastern_offset(day), 2, 2).cast("int")
    return orders.select("o_orderkey", F.date_sub(day, 45).alias("before"), (-offset).alias("shift"))


@query(
    "orders",
    sql="""SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F')""",
)
def above_high_water(orders):
    """Rows above the largest key that is stored (STM2)."""
    stored = orders.where("o_orderdate < timestamp '1996-01-01' AND o_orderstatus = 'F'")
    return incremental.above_mark(orders, "o_orderkey", stored).select("o_orderkey")


@query(
    "orders",
    sql="""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate) FROM orders)::DATE) <= 60""",
)
def recheck_window(orders):
    """Rows of the last sixty days that aren't done (STM3)."""
    return incremental.recheck(orders, "o_orderdate", F.col("o_orderstatus") == "F", 60).select("o_orderkey")


@query(
    "documents",
    sql="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'changed' END AS status FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""",
)
def content_changes(documents):
    """Rows whose content digest differs from the stored one (STM4, STR29)."""
    old = documents.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    state = incremental.changed(old, documents.select("doc_id", F.lit("").alias("digest")).limit(0), "doc_id", ["text", "lang"])
    return incremental.changed(documents, state, "doc_id", ["text", "lang"]).select("doc_id", "status")


@query(
    "orders",
    sql="""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS tried FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'P') < 3""",
)
def attempt_cap(orders):
    """Work tried fewer than three times (STM5)."""
    return incremental.attempts(orders.select("o_custkey").distinct(), orders.where("o_orderstatus = 'P'"), "o_custkey")


@query(
    "events",
    sql="""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 4""",
)
def rate_windows(events):
    """Windows of a key with many events, as a stream with a watermark counts them (STM7, STM8)."""
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = incremental.rate_windows(timed, "user_id", "ts", "1 day", "1 day", 4, "1 hour")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    "documents",
    sql=r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'))) AS loose_md5, md5(trim(regexp_replace(lower(text), '[\s-]+', ' ', 'g'))) AS plain_md5,
    CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 0 ELSE round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 6) END AS upper FROM documents""",
)
def text_forms(documents):
    """Normal forms of texts and their share of capitals (STR3, STR6, STR31)."""
    c = F.col("text")
    return documents.select(
        "doc_id",
        F.md5(text.loose(c)).alias("loose_md5"),
        F.md5(F.trim(text.spaces_for_hyphens(c))).alias("plain_md5"),
        F.round(text.upper_ratio(c), 6).alias("upper"),
    )


@query("documents")
def markdown_forms(documents):
    """Texts as one line, as markup, with footnotes and shortcodes expanded (STR11, STR12, STR13, STR14, STR24, STR32, UDF1)."""
    quote = F.concat(F.lit("{{quote:"), F.col("doc_id").cast("string"), F.lit("}}"))
    body = F.regexp_replace("text", "\n", " ")
    c = F.concat(F.lit("# Title "), F.col("source"), F.lit("\n**"), body, F.lit("** [1] "), quote, F.lit(" "), quote)
    html = text.footnotes_to_anchors(text.expand_shortcodes(text.markdown_to_html(c), F.col("source")))
    return documents.select("doc_id", text.summary_line(c).alias("line"), F.md5(html).alias("html_md5"), F.size(text.shortcodes(c)).alias("marks"), text.clean_agenda_title(c).alias("agenda_title"))
