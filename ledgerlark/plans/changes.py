"""Queries on changed tables: orders stand for stored rows, newer orders for what arrives."""

from pyspark.sql import functions as F

from ledgerlark.operators import dml, filters

from .registry import query


@query(
    "orders",
    sql="""WITH old AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    new AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
    SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM old)""",
)
def insert_ignore(orders):
    """New rows whose key isn't stored yet (SNK1, SNK2, SNK19)."""
    rows = orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    old, new = (rows.where(f"o_orderdate {c} timestamp '1996-01-01'").drop("o_orderdate") for c in ("<", ">="))
    first = dml.insert_ignore(old.limit(0), old, ["o_custkey"], ["o_orderkey"])
    return dml.insert_ignore(first, new, ["o_custkey"], ["o_orderkey"])


@query(
    "orders",
    sql="""SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderdate >= TIMESTAMP '1999-01-01') DESC, o_orderdate DESC, o_orderkey DESC) = 1""",
)
def upsert_replace(orders):
    """Whole rows replaced by newer ones (SNK3, EXT6)."""
    rows = orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    old, new = (rows.where(f"o_orderdate {c} timestamp '1999-01-01'") for c in ("<", ">="))
    return dml.upsert(old, new, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "events",
    sql="""SELECT user_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1""",
)
def counter_state(events):
    """Counters and dates of stored rows, raised by what arrives (SNK4)."""
    state = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    old, new = (state(events.where(f"ts {c} timestamp_ntz '2024-01-15'")) for c in ("<", ">="))
    both = old.unionByName(new)
    return both.groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query(
    "orders",
    sql="""WITH a AS (SELECT o_custkey, max(o_totalprice) AS best, min(o_orderpriority) AS label, '' AS note FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, max(o_totalprice) AS best, max(o_orderpriority) AS label, min(o_orderstatus) AS note FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT o_custkey, greatest(a.best, b.best) AS best, coalesce(a.label, b.label) AS label, coalesce(nullif(a.note, ''), b.note) AS note FROM a FULL JOIN b USING (o_custkey)""",
)
def merge_columns(orders):
    """Columns merged each by its rule (SNK5, SNK6, SNK7, EXT3, EXT20)."""
    old = orders.where("o_orderdate < timestamp '1998-01-01'").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("best"), F.min("o_orderpriority").alias("label"), F.lit("").alias("note")
    )
    new = orders.where("o_orderdate >= timestamp '1998-01-01'").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("best"), F.max("o_orderpriority").alias("label"), F.min("o_orderstatus").alias("note")
    )
    return dml.merge_columns(old, new, "o_custkey", {"best": "max", "label": "old", "note": "if_empty"})


@query(
    "orders",
    sql="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)
def tombstones(orders):
    """Rows but those that are listed as deleted (SNK8, SNK10, EXT25)."""
    return dml.delete_keys(orders.select("o_orderkey", "o_custkey"), orders.where("o_orderstatus = 'P'"), ["o_orderkey"])


@query("labels", "documents", sql="SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_purge(labels, documents):
    """Rows whose parent is there (SNK9, EXT23)."""
    return dml.delete_orphans(labels.select("doc_id", "quality"), documents.where("lang = 'en'"), ["doc_id"])


@query(
    "orders",
    sql="""SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01') OR o_orderdate >= TIMESTAMP '2001-06-01'""",
)
def replace_partitions(orders):
    """All rows of a key replaced by those that arrive (SNK11)."""
    rows = orders.select("o_custkey", "o_orderkey", "o_orderdate")
    new = rows.where("o_orderdate >= timestamp '2001-06-01'")
    return dml.replace_partitions(rows, new, ["o_custkey"]).drop("o_orderdate")


@query(
    "lineitem",
    sql="""SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 1 ELSE l_partkey END AS l_partkey FROM lineitem""",
)
def rekey_links(lineitem):
    """Links moved from merged keys to the kept ones, doubles dropped (SNK12, GRA7)."""
    from ledgerlark.operators import graph

    merged = lineitem.where("l_partkey % 10 = 0").select(F.col("l_partkey").alias("old"), (F.col("l_partkey") + 1).alias("new")).distinct()
    return graph.rekey(lineitem.select("l_orderkey", "l_partkey"), "l_partkey", merged, "old", "new")


@query("events", sql="SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 7")
def keep_seven_newest(events):
    """The newest seven snapshots of each store (SNK18)."""
    return dml.keep_newest(events.select("user_id", "event_id", "ts"), "user_id", "event_id", 7)


@query(
    "events",
    sql="""SELECT event_id, replace(replace(props, ',', ';'), chr(10), ' ') AS props, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events""",
)
def csv_safe(events):
    """Fields without what would break a row of a text file (SNK16, SNK20)."""
    safe = F.translate("props", ",\n", "; ")
    return events.select("event_id", safe.alias("props"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


@query(
    "orders",
    sql="""SELECT o_orderpriority, string_agg('- order ' || o_orderkey || ': ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS report
    FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10) GROUP BY 1""",
)
def rendered_report(orders):
    """The best ten rows of each group as a text of lines (SNK17, STR30)."""
    from ledgerlark.operators.graph import ranked_sections

    best = ranked_sections(orders, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")]).where("place <= 10")
    line = F.format_string("- order %d: %s", F.col("o_orderkey"), F.col("o_orderstatus"))
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("x"))))
    return best.groupBy("o_orderpriority").agg(F.array_join(F.transform(lines, lambda r: r["x"]), "\n").alias("report"))


# ---- selections over several stores -----------------------------------------------------------------------


@query(
    "part",
    sql="""WITH r AS (SELECT * FROM (VALUES ('small', 1, 15), ('medium', 10, 30), ('large', 25, 45)) t(category, low, high))
    SELECT category, p_partkey FROM part JOIN r ON p_size BETWEEN low AND high UNION ALL
    SELECT 'uncategorised', p_partkey FROM part WHERE p_size > 45""",
)
def multi_label_categories(part):
    """All categories whose rule a row fits, and the rest (EXT1)."""
    rules = {"small": (1, 15), "medium": (10, 30), "large": (25, 45)}
    found = F.array_compact(F.array(*[F.when(F.col("p_size").between(*r), name) for name, r in rules.items()]))
    rest = F.when(F.size(found) == 0, F.array(F.lit("uncategorised"))).otherwise(found)
    return part.select(F.explode(rest).alias("category"), "p_partkey")


@query(
    "events",
    sql="""SELECT CASE WHEN event_type = 'error' THEN 'out of window' WHEN value < 20 THEN 'upcoming' WHEN event_type = 'purchase' THEN 'upgrade' WHEN value < 60 THEN 'new' ELSE 'create' END AS action,
    count(*) AS n FROM events GROUP BY 1""",
)
def action_counts(events):
    """The action that each event's state asks for, counted (EXT4)."""
    action = (
        F.when(F.col("event_type") == "error", "out of window")
        .when(F.col("value") < 20, "upcoming")
        .when(F.col("event_type") == "purchase", "upgrade")
        .when(F.col("value") < 60, "new")
        .otherwise("create")
    )
    return events.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(
    "orders",
    sql="""WITH scanned AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
    todo AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS found FROM orders WHERE o_custkey NOT IN (SELECT * FROM scanned) GROUP BY 1)
    SELECT o_custkey, found, CASE WHEN found = 0 THEN 'nothing' ELSE 'new' END AS status FROM todo""",
)
def incremental_scan(orders):
    """Keys not scanned yet, with a mark where nothing was found so that they aren't scanned again (EXT7, STM1)."""
    scanned = orders.where("o_orderdate < timestamp '1996-01-01'").select("o_custkey")
    todo = orders.join(scanned, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("found"))
    return todo.select("o_custkey", "found", F.when(F.col("found") == 0, "nothing").otherwise("new").alias("status"))


@query(
    "orders",
    sql="""WITH m AS (SELECT * FROM (VALUES ('1-URGENT', 'desk'), ('2-HIGH', 'desk'), ('5-LOW', 'night')) t(o_orderpriority, author))
    SELECT coalesce(author, 'staff') AS author, count(*) AS n FROM orders LEFT JOIN m USING (o_orderpriority) GROUP BY 1""",
)
def mapped_author_counts(orders):
    """Counts by an author that several ids map to, others by a default (EXT8, MAP2, SRC18)."""
    authors = {"1-URGENT": "desk", "2-HIGH": "desk", "5-LOW": "night"}
    table = orders.sparkSession.createDataFrame(list(authors.items()), "o_orderpriority string, author string")
    joined = orders.join(F.broadcast(table), "o_orderpriority", "left")
    return joined.groupBy(F.coalesce("author", F.lit("staff")).alias("author")).agg(F.count("*").alias("n"))


@query(
    "part",
    "lineitem",
    sql="""SELECT p_name, count(*) AS rows FROM (SELECT p_partkey, p_name FROM part WHERE p_size = 7) JOIN lineitem ON p_partkey = l_partkey GROUP BY 1""",
)
def correction_scan(part, lineitem):
    """Rows that each proposed correction would change (EXT9)."""
    wrong = part.where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lineitem.join(wrong, "l_partkey").groupBy("p_name").agg(F.count("*").alias("rows"))


@query(
    "orders",
    sql="""WITH t AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tier FROM orders)
    SELECT o_custkey, o_orderkey, tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY o_custkey)""",
)
def fallback_chain(orders):
    """Rows of the first source that has any, for each key (EXT14, EXT15)."""
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = orders.select("o_custkey", "o_orderkey", tier.alias("tier"))
    best = rows.groupBy("o_custkey").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["o_custkey", "tier"]).select("o_custkey", "o_orderkey", "tier")


@query(
    "region",
    "nation",
    sql="""SELECT r_regionkey, coalesce(min(n_name) FILTER (WHERE n_name ILIKE '%ia%'), 'good service') AS status FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""",
)
def status_or_default(region, nation):
    """The first entry that mentions a key, else a default (EXT17)."""
    found = nation.where(F.col("n_name").ilike("%ia%")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min("n_name").alias("status"))
    return region.join(found, "r_regionkey", "left").select("r_regionkey", F.coalesce("status", F.lit("good service")).alias("status"))


@query(
    "customer",
    "orders",
    sql="""SELECT c_custkey, (count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') > 0)::INT AS captions, (count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') > 0)::INT AS video,
    (count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') > 0)::INT AS transcript FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def presence_matrix(customer, orders):
    """Which of several kinds of records each key has (EXT19, DQ15)."""
    kinds = {"captions": "F", "video": "O", "transcript": "P"}
    has = orders.groupBy("o_custkey").agg(*[F.max((F.col("o_orderstatus") == s).cast("int")).alias(k) for k, s in kinds.items()])
    joined = customer.join(has, customer.c_custkey == has.o_custkey, "left")
    return joined.select("c_custkey", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query(
    "part",
    sql=r"""SELECT p_partkey, TRY_CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) AS number, lower(replace(p_name, ' ', '-')) AS slug,
    TRY_CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) <= 30 AS early, split_part(p_type, ' ', 1) AS kind FROM part""",
)
def table_of_contents(part):
    """Numbers and slugs out of names, and a split of the list at a number (EXT18, EXT21, STR2)."""
    from ledgerlark.functions import text

    number = F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int")
    kind = F.split("p_type", " ")[0]
    return part.select("p_partkey", number.alias("number"), text.simple_slug(F.col("p_name")).alias("slug"), (number <= 30).alias("early"), kind.alias("kind"))


@query(
    "part",
    sql="""SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size >= 25 AND p_retailprice > 1000 THEN 0 ELSE 1 END, p_partkey) = 1""",
)
def first_acceptable(part):
    """The first row that meets a preference, else the first (EXT24)."""
    fails = F.when((F.col("p_size") >= 25) & (F.col("p_retailprice") > 1000), 0).otherwise(1)
    best = part.groupBy("p_brand").agg(F.min(F.struct(fails.alias("f"), "p_partkey")).alias("b"))
    return best.select("p_brand", F.col("b.p_partkey").alias("p_partkey"))


@query(
    "documents",
    "labels",
    sql="""SELECT lang, source, doc_id FROM documents d WHERE length(text) > 500 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY lang, source, doc_id""",
)
def eligible_work(documents, labels):
    """Rows that are long enough and not done yet, in a listing's order (EXT27, EXT28, EXT30)."""
    long = documents.where(filters.has_text("text") & (F.length("text") > 500))
    return long.join(labels, "doc_id", "left_anti").select("lang", "source", "doc_id").orderBy("lang", "source", "doc_id")


@query(
    "conversations",
    sql="""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Resident' WHEN 'assistant' THEN 'Clerk' ELSE role END AS speaker FROM conversations""",
)
def relabelled_speakers(conversations):
    """Speakers looked up in a map by two forms of their label, else as they are (MAP1, EXT31, DQ9)."""
    names = F.create_map(F.lit("user"), F.lit("Resident"), F.lit("Speaker assistant"), F.lit("Clerk"))
    speaker = F.coalesce(
        F.try_element_at(names, F.col("role")), F.try_element_at(names, F.concat(F.lit("Speaker "), F.col("role"))), F.col("role")
    )
    return conversations.select("conv_id", "turn", speaker.alias("speaker"))


@query("region", "nation", sql="SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS members FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def catalogue_lists(region, nation):
    """Sorted lists of a catalogue (EXT33, MAP3)."""
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("members"))
