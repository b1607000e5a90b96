"""Joins and ordered computations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.operators import dictionary, joins, windows

from .registry import query


@query(
    "lineitem",
    "orders",
    "customer",
    sql="SELECT DISTINCT c_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
)
def bridge_distinct(lineitem, orders, customer):
    """Distinct ends of a join through a bridge table (JN1, JN7)."""
    builders = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    wanted = orders.select("o_orderkey", "o_custkey").join(builders, "o_custkey")
    lines = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return lines.join(wanted, "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "l_partkey").distinct()


@query("documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_unlabelled(documents, labels):
    """Rows without a partner (JN3, JN4)."""
    return documents.select("doc_id").join(labels.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_anti")


@query("documents", "labels", sql="SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_labelled(documents, labels):
    """Rows with a partner (JN6, SRC4)."""
    return documents.join(labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query(
    "lineitem",
    "orders",
    sql="""SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey
    AND o.o_orderdate = l.l_shipdate) GROUP BY 1""",
)
def not_exists_composite(lineitem, orders):
    """Rows without a partner on two columns (JN5)."""
    there = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("l_shipdate"))
    return lineitem.join(there, ["l_orderkey", "l_shipdate"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    "lineitem",
    sql="""WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
    GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 15""",
)
def cooccurrence_top(lineitem):
    """Members that most often share a group, a top-15 report (JN8, GRA11)."""
    return joins.co_occurring(lineitem, "l_orderkey", "l_partkey").orderBy(F.desc("n"), "a", "b").limit(15)


@query(
    "customer",
    "orders",
    sql="""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_final FROM customer""",
)
def scalar_subquery_counts(customer, orders):
    """Correlated counts, aggregated before one join (JN9)."""
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"))
    joined = customer.join(counts, customer.c_custkey == counts.o_custkey, "left")
    return joined.select("c_custkey", F.coalesce("a", F.lit(0)).alias("n_orders"), F.coalesce("b", F.lit(0)).alias("n_final"))


@query(
    "orders",
    sql="""WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
    x AS (SELECT a.o_orderkey, b.o_orderkey AS other, abs(a.d - b.d) AS days, row_number() OVER (PARTITION BY a.o_orderkey
    ORDER BY abs(a.d - b.d), (b.pos > a.pos)::INT, abs(b.pos - a.pos)) AS place FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey)
    SELECT o_orderkey, other, days::INT AS days, place::INT AS place FROM x WHERE place <= 4""",
)
def nearest_date_related(orders):
    """The four rows of the same group that are nearest in date (JN10, DT1)."""
    return joins.nearest_in_group(orders, "o_custkey", "o_orderdate", "o_orderkey", 4)


@query(
    "orders",
    sql="""WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
    x AS (SELECT a.o_orderkey AS open_key, b.o_orderkey AS final_key, abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) AS days FROM a JOIN b USING (o_custkey))
    SELECT open_key, final_key, days::INT AS days FROM x WHERE days <= 30 QUALIFY row_number() OVER (PARTITION BY open_key ORDER BY days, final_key) = 1""",
)
def band_join_nearest(orders):
    """The nearest partner within a band of days (JN11)."""
    a = orders.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("open_key"), "o_orderdate")
    b = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("final_key"), F.col("o_orderdate").alias("done"))
    return joins.band_nearest(a, b, "o_custkey", "o_orderdate", "done", "open_key", "final_key", 30)


@query(
    "orders",
    sql="""WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
    exact AS (SELECT a.o_orderkey AS open_key, min(b.o_orderkey) AS final_key, 0 AS tier FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate GROUP BY 1),
    near AS (SELECT a.o_orderkey AS open_key, b.o_orderkey AS final_key, 1 AS tier FROM a JOIN b ON a.o_custkey = b.o_custkey
      AND abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)) <= 20
      QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(CAST(a.o_orderdate AS DATE) - CAST(b.o_orderdate AS DATE)), b.o_orderkey) = 1),
    alike AS (SELECT a.o_orderkey AS open_key, min(b.o_orderkey) AS final_key, 2 AS tier FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority GROUP BY 1)
    SELECT * FROM (SELECT * FROM exact UNION ALL SELECT * FROM near UNION ALL SELECT * FROM alike) QUALIFY row_number() OVER (PARTITION BY open_key ORDER BY tier) = 1""",
)
def cascading_match(orders):
    """Exact match, else the nearest in a band, else one with an equal attribute (JN17, JN18)."""
    a = orders.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("open_key"), "o_orderdate", "o_orderpriority")
    b = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("final_key"), F.col("o_orderdate").alias("done"), "o_orderpriority")
    first = lambda df: df.groupBy("open_key").agg(F.min("final_key").alias("final_key"))
    exact = first(a.join(b.withColumnRenamed("done", "o_orderdate"), ["o_custkey", "o_orderdate"]))
    near = joins.band_nearest(a, b, "o_custkey", "o_orderdate", "done", "open_key", "final_key", 20).drop("days")
    least = b.groupBy("o_custkey", "o_orderpriority").agg(F.min("final_key").alias("final_key"))
    alike = a.join(least, ["o_custkey", "o_orderpriority"]).select("open_key", "final_key")
    return joins.cascade(exact, near, alike, key="open_key")


def _spans(events, kinds, minutes):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 60
    return events.where(F.col("event_type").isin(*kinds)).select("user_id", "event_id", at.alias("start"), (at + minutes).alias("end"), "value")


@query(
    "events",
    sql="""WITH e AS (SELECT *, epoch(ts) / 60.0 AS m FROM events),
    a AS (SELECT user_id, event_id, m AS s, m + 600 AS t FROM e WHERE event_type IN ('view', 'click')),
    b AS (SELECT user_id, value, m AS s, m + 900 AS t FROM e WHERE event_type IN ('purchase', 'error'))
    SELECT event_id, count(*) AS n, round(sum(value * (least(a.t, b.t) - greatest(a.s, b.s))) / sum(least(a.t, b.t) - greatest(a.s, b.s)), 4) AS mean_value
    FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.t AND a.t > b.s GROUP BY 1""",
)
def interval_overlap_weighted(events):
    """Mean of the values of overlapping intervals, weighted by the overlap (JN12, AGG19)."""
    left = _spans(events, ["view", "click"], 600).drop("value")
    right = _spans(events, ["purchase", "error"], 900).select("user_id", "start", "end", "value")
    pairs = joins.overlaps(left, right, "user_id", 1440.0)
    mean = F.sum(F.col("value") * F.col("overlap")) / F.sum("overlap")
    return pairs.groupBy("event_id").agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean_value"))


@query(
    "events",
    sql="""WITH e AS (SELECT *, epoch(ts) / 60.0 AS m FROM events),
    p AS (SELECT user_id, event_id AS point, m FROM e WHERE event_type = 'click'),
    i AS (SELECT user_id, event_id AS span, m AS s, m + 120 AS t FROM e WHERE event_type = 'view'),
    x AS (SELECT point, span, (m >= s - 60 AND m <= t + 60) AS inside, least(abs(m - s), abs(m - t)) AS d, s FROM p JOIN i USING (user_id))
    SELECT point, span, inside FROM x WHERE inside OR d <= 440
    QUALIFY row_number() OVER (PARTITION BY point ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE d END, s, span) = 1""",
)
def asof_nearest_within(events):
    """The interval that holds a point, else the nearest within reach (JN13)."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 60
    points = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("point"), at.alias("at"))
    spans = _spans(events, ["view"], 120).select("user_id", F.col("event_id").alias("span"), "start", "end")
    return joins.point_in_interval(points, spans, "user_id", "point", "span", 60.0, 440.0)


@query(
    "documents",
    "part",
    sql=r"""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT 'the re' UNION SELECT 'licensed under' UNION SELECT 'idiot'),
    t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents)
    SELECT doc_id, name FROM t JOIN n ON contains(t, ' ' || trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ')""",
)
def entity_mentions(documents, part):
    """Documents that have a name as whole words (JN14, GRA3)."""
    names = part.select(F.split("p_name", " ")[0].alias("name")).distinct()
    more = part.sparkSession.createDataFrame([("the re",), ("licensed under",), ("idiot",)], "name string")
    return dictionary.mentions(documents, names.union(more), "doc_id", "text", "name")


@query(
    "documents",
    sql=r"""WITH n AS (SELECT DISTINCT 'chair ' || source AS name FROM documents UNION SELECT unnest(['License', 'licensed under', 'idiot', 'and the', 'Chair SRC1'])),
    d AS (SELECT doc_id, lower('Chair ' || source) AS s, lower(text) AS t FROM documents)
    SELECT doc_id, name, CASE WHEN contains(s, lower(name)) THEN 'spoke' ELSE 'mentioned' END AS relation FROM d JOIN n ON contains(s, lower(name)) OR contains(t, lower(name)) WHERE length(name) >= 6""",
)
def speakers_and_mentions(documents):
    """Who a document is by, or else whom it mentions, by names of six characters or more (JN14, GRA3)."""
    told = documents.select("doc_id", F.concat(F.lit("Chair "), "source").alias("speaker"), "text", F.concat(F.lit("chair "), "source").alias("name"))
    more = [(n,) for n in ("License", "licensed under", "idiot", "and the", "Chair SRC1")]
    names = told.select("name").distinct().union(documents.sparkSession.createDataFrame(more, "name string"))
    return dictionary.linked(told, names, "doc_id", "speaker", "text", "name")


@query(
    "documents",
    "labels",
    sql="""SELECT doc_id, coalesce(a.quality, b.toxic) AS value, CASE WHEN a.quality IS NOT NULL THEN 'first' WHEN b.toxic IS NOT NULL THEN 'second' END AS store
    FROM documents LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) a USING (doc_id) LEFT JOIN labels b USING (doc_id)""",
)
def two_store_lookup(documents, labels):
    """A value from the first store that has it (JN19, JN21)."""
    first = labels.where("toxic = 0").select("doc_id", F.col("quality").alias("value"))
    return joins.fallback_lookup(documents, first, labels.select("doc_id", F.col("toxic").alias("value")), "doc_id", "value")


@query(
    "part",
    "lineitem",
    sql="SELECT DISTINCT p_partkey, l_orderkey FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_name ILIKE '%red%' OR p_type ILIKE '%brass%'",
)
def attached_matches(part, lineitem):
    """Attachments whose name or kind matches, with what they belong to (JN20, EXT29)."""
    wanted = part.where(F.col("p_name").ilike("%red%") | F.col("p_type").ilike("%brass%"))
    return wanted.join(lineitem, wanted.p_partkey == lineitem.l_partkey).select("p_partkey", "l_orderkey").distinct()


@query(
    "orders",
    sql="""WITH k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'yt-' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '0' || o_orderkey ELSE o_orderkey::VARCHAR END AS doc_id FROM orders)
    SELECT o_orderkey, doc_id FROM orders JOIN k ON o_orderkey::VARCHAR = coalesce(TRY_CAST(doc_id AS BIGINT)::VARCHAR, doc_id)""",
)
def cast_mismatch_join(orders):
    """Whole-number keys joined with text keys of several shapes (JN22)."""
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("yt-"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("0"), key.cast("string"))).otherwise(key.cast("string"))
    other = orders.select(text.alias("doc_id"))
    left = orders.select("o_orderkey", joins.same_key_as_text(key).alias("k"))
    right = other.select("doc_id", joins.same_key_as_text(F.col("doc_id")).alias("k"))
    return left.join(right, "k").select("o_orderkey", "doc_id")


# ---- windows ----------------------------------------------------------------------------------------------


@query(
    "events",
    sql="""WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
    SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id, round(sum(value), 3) AS total FROM i GROUP BY 1, 2""",
)
def speaker_turn_islands(events):
    """Consecutive rows of one kind as one (WIN1, WIN16, CHK5)."""
    order = ["ts", "event_id"]
    change = F.lag("event_type").over(windows.order_window(["user_id"], order)) != F.col("event_type")
    numbered = windows.islands(events, ["user_id"], order, change)
    return numbered.groupBy("user_id", "island").agg(
        F.first("event_type").alias("event_type"),
        F.count("*").alias("n"),
        F.min("event_id").alias("first_id"),
        F.round(F.sum("value"), 3).alias("total"),
    )


@query(
    "events",
    sql="""WITH f AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 440 * 60 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
    SELECT user_id, island::BIGINT AS island, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM i GROUP BY 1, 2""",
)
def gap_islands(events):
    """Sessions parted by a gap in time (WIN2, WIN3)."""
    order = ["ts", "event_id"]
    return (
        windows.islands(events, ["user_id"], order, windows.gap("ts", windows.order_window(["user_id"], order)) >= 440 * 60)
        .groupBy("user_id", "island")
        .agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    )


@query(
    "events",
    sql=r"""WITH RECURSIVE e AS (SELECT user_id, event_type AS speaker, epoch_us(ts) / 1e6 / 60 AS start, epoch_us(ts) / 1e6 / 60 + 1 AS "end", event_type || ' ' || props AS text,
    CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN NULL ELSE 'neutral' END AS f FROM events),
    n AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w, row_number() OVER (PARTITION BY user_id ORDER BY start, "end", text) AS i FROM e),
    r AS (SELECT user_id, i, 0 AS turn_no, speaker, start, "end", text, 1 AS n_merged, w, coalesce(f, 'neutral') AS f FROM n WHERE i = 1
    UNION ALL SELECT user_id, i, turn_no + (NOT same)::INT, speaker, CASE WHEN same THEN s0 ELSE start END, "end", CASE WHEN same THEN t0 || ' ' || text ELSE text END,
    CASE WHEN same THEN m0 + 1 ELSE 1 END, CASE WHEN same THEN w0 + w ELSE w END, CASE WHEN same AND (f0 <> 'neutral' OR f IS NULL) THEN f0 ELSE coalesce(f, 'neutral') END
    FROM (SELECT n.user_id, n.i, r.turn_no, n.speaker, r.start AS s0, n.start, n."end", r.text AS t0, n.text, r.n_merged AS m0, r.w AS w0, n.w, r.f AS f0, n.f,
    (r.speaker = n.speaker AND n.start - r."end" < 600 AND r.w < 12) AS same FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))
    SELECT user_id, turn_no, any_value(speaker) AS speaker, arg_max(start, i) AS start, arg_max("end", i) AS "end", arg_max(text, i) AS text, max(n_merged)::INT AS n_merged, arg_max(f, i) AS sentiment FROM r GROUP BY 1, 2""",
)
def merged_turns(events):
    """Turns merged with a gap, a cap of words and the more expressive sentiment (WIN2, WIN3)."""
    at, k = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 60, F.col("event_id") % 5
    felt = F.when(k == 0, "positive").when(k == 1, "negative").when(k > 2, "neutral")
    text = F.concat_ws(" ", "event_type", "props").alias("text")
    said = events.select("user_id", F.col("event_type").alias("speaker"), at.alias("start"), (at + 1).alias("end"), text, felt.alias("sentiment"))
    return windows.merge_turns(said, "user_id", max_gap=600.0, max_words=12)


@query("conversations")
def rolling_captions(conversations):
    """Texts without the words that rolled over from the one before (WIN4)."""
    rolled = F.concat_ws(" ", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), "text")
    return windows.drop_caption_overlap(conversations.withColumn("text", rolled), "conv_id", "turn", "text")


@query(
    "conversations",
    sql="""SELECT conv_id, turn, coalesce(lag(text) OVER w || chr(10), '') || text || coalesce(chr(10) || lead(text) OVER w, '') AS context
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def neighbour_context(conversations):
    """A row with its neighbours' texts (WIN5, WIN6, SCH13)."""
    return windows.neighbours(conversations, "conv_id", "turn", "text", 1, "context").select("conv_id", "turn", "context")


@query(
    "conversations",
    sql="""SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS a, lead(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE length(text) < 120 AND a = b AND a <> role""",
)
def orphan_turns(conversations):
    """Short turns between two of another speaker (WIN7)."""
    over = Window.partitionBy("conv_id").orderBy("turn")
    sides = conversations.withColumns({"a": F.lag("role").over(over), "b": F.lead("role").over(over)})
    return sides.where((F.length("text") < 120) & (F.col("a") == F.col("b")) & (F.col("a") != F.col("role"))).select("conv_id", "turn")


@query(
    "events",
    sql="""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS kind, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap < 1800 AND kind <> event_type""",
)
def rapid_switch(events):
    """Changes of kind soon after the row before (WIN8)."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    with_last = events.withColumns({"gap": windows.gap("ts", over), "kind": F.lag("event_type").over(over)})
    return with_last.where((F.col("gap") < 1800) & (F.col("kind") != F.col("event_type"))).select("event_id")


@query(
    "nation",
    sql="SELECT n_nationkey, n_name, lag(n_name) OVER w AS previous, lead(n_name) OVER w AS next FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)",
)
def prev_next_nav(nation):
    """The neighbours in a sorted listing (WIN10)."""
    over = Window.partitionBy("n_regionkey").orderBy("n_name")
    return nation.select("n_nationkey", "n_name", F.lag("n_name").over(over).alias("previous"), F.lead("n_name").over(over).alias("next"))


@query(
    "orders",
    sql="""SELECT o_custkey, max(o_orderdate) AS newest, arg_max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, (o_orderdate, o_orderkey)) AS subject
    FROM orders GROUP BY 1""",
)
def latest_with_fill(orders):
    """The newest row of each key, a missing value filled from the newest row that has one (WIN11)."""
    has = F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))
    grouped = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.max(has).alias("h"))
    return grouped.select("o_custkey", "newest", F.col("h.o_orderpriority").alias("subject"))


@query(
    "events",
    sql="""WITH m AS (SELECT max(ts) AS now FROM events)
    SELECT event_type, max(ts) AS last_run, max(ts) FILTER (WHERE value >= 50) AS last_success, arg_max(user_id, (ts, event_id)) AS last_user,
    coalesce(epoch(any_value(now)) - epoch(max(ts) FILTER (WHERE value >= 50)) > 3600 * 24, true) AS late FROM events, m GROUP BY 1""",
)
def job_sla(events):
    """Last run and last success of each job, and whether success is overdue (WIN12, DQ14, DT6)."""
    now = events.agg(F.max("ts").alias("now"))
    good = F.max(F.when(F.col("value") >= 50, F.col("ts")))
    runs = events.groupBy("event_type").agg(
        F.max("ts").alias("last_run"), good.alias("last_success"), F.max(F.struct("ts", "event_id", "user_id")).alias("l")
    )
    late = F.coalesce(F.unix_timestamp("now") - F.unix_timestamp("last_success") > 3600 * 24, F.lit(True))
    return runs.join(F.broadcast(now)).select(
        "event_type", "last_run", "last_success", F.col("l.user_id").alias("last_user"), late.alias("late")
    )


@query(
    "conversations",
    sql="""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations""",
)
def label_carry_forward(conversations):
    """The last value that was set (WIN14)."""
    marked = conversations.withColumn("q", F.when(F.col("role") == "user", F.col("text")))
    return windows.carry_forward(marked, ["conv_id"], ["turn"], "q", "asked").select("conv_id", "turn", "asked")


@query(
    "events",
    sql="""WITH f AS (SELECT *, sum((value < 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM events),
    s AS (SELECT *, max((ahead = 4)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop FROM f)
    SELECT event_id FROM s WHERE stop = 0""",
)
def scan_cutoff(events):
    """Rows before the first run of four that are empty (WIN15)."""
    return windows.before_empty_run(events, ["user_id"], ["ts", "event_id"], F.col("value") < 50, 4).select("event_id")


@query(
    "orders",
    sql="SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 5 = 0",
)
def every_nth(orders):
    """Systematic sampling: every fifth row (WIN17)."""
    return windows.every_nth(orders.select("o_orderkey"), ["o_orderkey"], 5)


@query(
    "conversations",
    sql="""SELECT conv_id, ((r - 1) // 4)::INT AS batch, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS rendered
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1, 2""",
)
def rendered_batches(conversations):
    """Batches of rows of a fixed size rendered as text (EXT11, ETL3)."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    line = F.format_string("[%d] %s: %s", F.col("turn"), F.col("role"), F.col("text"))
    cut = conversations.select("conv_id", "turn", F.floor((place - 1) / 4).cast("int").alias("batch"), line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return cut.groupBy("conv_id", "batch").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("rendered"))
