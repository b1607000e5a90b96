"""Reports: filters, predicates, grouped and conditional aggregates, sorting, paging and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import filters, paging, sets, windows

from .registry import query


@query("orders", sql="SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_count_desc(orders):
    """Rows per key, most frequent first (AGG3)."""
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@query(
    "orders",
    sql="""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final,
    count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large,
    count(*) FILTER (WHERE o_orderpriority ILIKE '1-%') AS n_urgent FROM orders""",
)
def multi_filtered_counts(orders):
    """Many filtered counts in one pass (AGG1, AGG2)."""
    return orders.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_final"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.count_if(F.col("o_totalprice") > 200000).alias("n_large"),
        F.count_if(F.col("o_orderpriority").ilike("1-%")).alias("n_urgent"),
    )


@query(
    "lineitem",
    sql="""SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts,
    count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1""",
)
def count_distinct_multi(lineitem):
    """Exact distinct counts of several columns by group (AGG4).

    Each column is counted from its own distinct pairs, so no row is expanded once per column.
    """
    counts = None
    for column, name in (("l_orderkey", "n_orders"), ("l_partkey", "n_parts"), ("l_suppkey", "n_suppliers")):
        one = lineitem.select("l_returnflag", column).distinct().groupBy("l_returnflag").agg(F.count(column).alias(name))
        counts = one if counts is None else counts.join(one, "l_returnflag")
    return counts


@query(
    "lineitem",
    sql="""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, min(l_shipdate) AS first_ship,
    max(l_shipdate) AS last_ship, floor(sum(l_quantity) / count(*))::BIGINT AS whole_mean, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def grouped_totals(lineitem):
    """Sum, minimum, maximum and the whole-number mean (AGG5)."""
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.floor(F.sum("l_quantity") / F.count("*")).alias("whole_mean"),
        F.count("*").alias("n"),
    )


@query(
    "customer",
    "orders",
    sql="""SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders,
    sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS final,
    sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def conditional_sum_coverage(customer, orders):
    """Coverage table: conditional sums over a left join (AGG6, JN2). Orders are counted per customer before the join."""
    per_customer = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("final"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
    )
    joined = customer.join(per_customer, customer.c_custkey == per_customer.o_custkey, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c if c != "n" else "orders")
    return joined.groupBy("c_mktsegment").agg(
        F.count_distinct("c_custkey").alias("customers"), total("n"), total("final"), total("open")
    )


@query(
    "orders",
    sql="SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1",
)
def group_concat(orders):
    """Distinct values of a group as text (AGG7)."""
    return orders.groupBy("o_orderpriority").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses")
    )


@query(
    "customer",
    "orders",
    sql="""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, '; ' ORDER BY rn), '') AS top_orders
    FROM customer LEFT JOIN r ON c_custkey = o_custkey AND rn <= 2 GROUP BY 1""",
)
def listagg_top2(customer, orders):
    """The two largest members of each group as ordered text (AGG8)."""
    by_size = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = (
        orders.withColumn("rn", F.row_number().over(by_size))
        .where("rn <= 2")
        .groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "o_orderkey"))).alias("top"))
    )
    listed = F.array_join(F.transform("top", lambda t: t["o_orderkey"].cast("string")), "; ")
    joined = customer.join(top, customer.c_custkey == top.o_custkey, "left")
    return joined.select("c_custkey", F.coalesce(listed, F.lit("")).alias("top_orders"))


@query(
    "orders",
    sql="""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best_order, max(o_totalprice) AS best_price
    FROM orders GROUP BY 1""",
)
def argmax_per_group(orders):
    """A column of the row with the largest value (AGG9); ties go to the larger key."""
    best = F.max(F.struct("o_totalprice", "o_orderkey"))
    grouped = orders.groupBy("o_custkey").agg(best.alias("b"))
    return grouped.select("o_custkey", F.col("b.o_orderkey").alias("best_order"), F.col("b.o_totalprice").alias("best_price"))


@query("documents", sql="SELECT lang, min(source) AS source, count(*) AS n FROM documents GROUP BY 1")
def bare_column(documents):
    """A column outside the grouping, made definite by its minimum (AGG10)."""
    return documents.groupBy("lang").agg(F.min("source").alias("source"), F.count("*").alias("n"))


@query("lineitem", sql="SELECT trunc(l_quantity / 5)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def score_histogram(lineitem):
    """Histogram on a value cut to a whole number (AGG11)."""
    return lineitem.groupBy((F.col("l_quantity") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(
    "customer",
    "orders",
    sql="""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders
    ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1""",
)
def child_counts_with_zero(customer, orders):
    """Children per parent, none included (AGG12)."""
    counts = orders.where("o_orderdate >= timestamp '2001-01-01'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = customer.join(counts, customer.c_custkey == counts.o_custkey, "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "documents",
    "labels",
    sql="""SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled,
    round(CASE WHEN count(*) > 0 THEN 100.0 * count(l.doc_id) / count(*) END, 4) AS percent
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
)
def coverage_percent(documents, labels):
    """Share of rows that another table covers, in percent (AGG13)."""
    marked = documents.join(labels.select("doc_id", F.lit(1).alias("hit")).distinct(), "doc_id", "left")
    share = F.round(F.try_divide(F.lit(100.0) * F.count("hit"), F.count("*")), 4)
    return marked.groupBy("lang").agg(F.count("*").alias("docs"), F.count("hit").alias("labelled"), share.alias("percent"))


@query(
    "embeddings",
    sql="SELECT label, count(*) AS n, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings GROUP BY 1",
)
def vector_bytes(embeddings):
    """Bytes of stored vectors (AGG14)."""
    return embeddings.groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.size("embedding") * 4).cast("bigint").alias("bytes")
    )


@query(
    "documents",
    sql=r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS word FROM documents)
    GROUP BY 1 HAVING count(*) >= 20""",
)
def frequent_names(documents):
    """Capitalised words by number, frequent ones alone (AGG15)."""
    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")


@query(
    "documents",
    sql="""SELECT line, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(line) >= 8 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 15""",
)
def boilerplate_lines(documents):
    """Lines that many documents have (AGG17)."""
    return filters.lines_in_many(documents, "doc_id", "text", min_docs=15, min_chars=8)


@query(
    "labels",
    sql="""SELECT count(*) AS n, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement,
    count(*) FILTER (WHERE quality <> 1 - toxic) AS differ FROM labels""",
)
def label_agreement(labels):
    """How often two labellings agree after both are brought to one scale (AGG18, DQ21)."""
    same = F.col("quality") == 1 - F.col("toxic")
    return labels.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 6).alias("agreement"),
        F.count_if(~same).alias("differ"),
    )


@query(
    "lineitem",
    sql="""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_price
    FROM lineitem GROUP BY 1""",
)
def weighted_mean(lineitem):
    """Mean with weights (AGG19)."""
    mean = F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")
    return lineitem.groupBy("l_returnflag").agg(F.round(mean, 4).alias("weighted_price"))


@query(
    "orders",
    sql="""WITH d AS (SELECT strftime(o_orderdate, '%m-%d') AS day, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
    h AS (SELECT day, avg(total) AS usual FROM d WHERE y < 2000 GROUP BY 1)
    SELECT day, y::INT AS y, round(total - usual, 5) AS diff, round(100 * (total - usual) / usual, 3) AS pct FROM d JOIN h USING (day) WHERE y >= 2000""",
)
def seasonal_mean_diff(orders):
    """A day's total against the mean of the same day in earlier years (AGG20, MTH4, DT10)."""
    daily = orders.groupBy(
        F.date_format("o_orderdate", "MM-dd").alias("day"), F.year("o_orderdate").alias("y")
    ).agg(F.sum("o_totalprice").alias("total"))
    usual = daily.where("y < 2000").groupBy("day").agg(F.avg("total").alias("usual"))
    diff = F.col("total") - F.col("usual")
    return daily.where("y >= 2000").join(usual, "day").select(
        "day", "y", F.round(diff, 5).alias("diff"), F.round(100 * diff / F.col("usual"), 3).alias("pct")
    )


@query(
    "conversations",
    sql=r"""SELECT role, count(*) AS turns, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')))::BIGINT AS words
    FROM conversations GROUP BY 1""",
)
def speaker_word_counts(conversations):
    """Utterances and words per speaker (AGG21, STR10)."""
    return conversations.groupBy("role").agg(
        F.count("*").alias("turns"), F.sum(text.word_count(F.col("text"))).cast("bigint").alias("words")
    )


@query(
    "orders",
    sql="""SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
    FROM orders GROUP BY 1, 2""",
)
def nested_groups(orders):
    """Groups with their members' count and ends, as a nested listing would show (AGG22)."""
    return orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query(
    "orders",
    sql="""SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
    ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) = 1""",
)
def best_of_group(orders):
    """The member of each group with the best status, then the largest value (AGG23)."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), (-F.col("o_totalprice")).alias("p"), "o_orderkey", "o_orderstatus"))
    return orders.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_orderstatus")


@query(
    "orders",
    sql="""WITH m AS (SELECT max(o_orderdate) AS last FROM orders), days AS (SELECT DISTINCT o_orderdate FROM orders)
    SELECT o_orderdate, CASE WHEN o_orderdate >= last - INTERVAL 10 DAY THEN 'upcoming' WHEN day(o_orderdate) <= 15 THEN 'covered' ELSE 'missing' END AS status
    FROM days, m""",
)
def schedule_status(orders):
    """State of each scheduled date against a reference date taken from the data (AGG25, DT7)."""
    last = orders.agg(F.max("o_orderdate").alias("last"))
    days = orders.select("o_orderdate").distinct().join(F.broadcast(last))
    status = (
        F.when(F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 10 DAY"), "upcoming")
        .when(F.dayofmonth("o_orderdate") <= 15, "covered")
        .otherwise("missing")
    )
    return days.select("o_orderdate", status.alias("status"))


@query(
    "documents",
    sql=r"""SELECT lang, sum(length(text))::BIGINT AS before, sum(length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')))::BIGINT AS after,
    round(100.0 * (sum(length(text)) - sum(length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')))) / sum(length(text)), 4) AS percent
    FROM documents GROUP BY 1""",
)
def reduction_percent(documents):
    """Total sizes before and after cleaning, and the reduction in percent (AGG26)."""
    sizes = documents.select(
        "lang", F.length("text").alias("a"), F.length(F.regexp_replace("text", "[^a-zA-Z ]", "")).alias("b")
    )
    before, after = F.sum("a"), F.sum("b")
    return sizes.groupBy("lang").agg(
        before.alias("before"), after.alias("after"), F.round(F.lit(100.0) * (before - after) / before, 4).alias("percent")
    )


# ---- filters ------------------------------------------------------------------------------------------------


@query(
    "part",
    sql="""SELECT p_partkey FROM part WHERE (p_name ILIKE '%red%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%')
    AND p_size BETWEEN 5 AND 40 AND p_name NOT ILIKE 'blue%'""",
)
def ilike_multi_column(part):
    """Case-insensitive search over several columns with an excluded prefix and a range (FLT4, FLT5, FLT7, SCH15)."""
    found = filters.any_contains(part, ["p_name", "p_brand", "p_type"], "red")
    return found.where(F.col("p_size").between(5, 40) & ~F.col("p_name").ilike("blue%")).select("p_partkey")


@query(
    "part",
    sql="""SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_retailprice < 1500 AND p_name ILIKE '%plate%'""",
)
def dynamic_filter(part):
    """A filter built from the conditions that are set (FLT10)."""
    conditions = filters.build(min_size=10, below_price=1500, contains="plate", brand=None)
    return part.where(conditions).select("p_partkey", "p_name")


@query("orders", sql="SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderkey = 7 OR o_orderkey IN (3, 5, 11)")
def alternate_keys(orders):
    """Lookup by either of two keys, or one of a list (SRC1, FLT2, FLT3)."""
    wanted = (F.col("o_custkey") == 7) | (F.col("o_orderkey") == 7) | F.col("o_orderkey").isin(3, 5, 11)
    return orders.where(wanted).select("o_orderkey")


@query(
    "orders",
    sql="""SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN
    (SELECT CAST(max(o_orderdate) AS DATE) - 45 FROM orders) AND (SELECT CAST(max(o_orderdate) AS DATE) - 14 FROM orders)""",
)
def recent_window(orders):
    """Rows in a window of days before a reference date, the newest in the data (FLT8, FLT9, DT2)."""
    return filters.days_before(orders, "o_orderdate", first=45, last=14).select("o_orderkey")


@query(
    "documents",
    sql="""SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> '' AND length(text) BETWEEN 100 AND 1000""",
)
def sized_texts(documents):
    """Texts that are present and of a length in a range (FLT1, FLT11)."""
    return documents.where(filters.has_text("text") & F.length("text").between(100, 1000)).select(
        "doc_id", F.length("text").alias("n")
    )


@query(
    "part",
    sql="""SELECT p_partkey, regexp_matches(p_name, '^[0-9]') AS digit_first, length(p_name) < 3 OR lower(p_name) IN ('unknown', 'n/a')
    OR strpos(p_name, ' ') = 0 AS junk FROM part""",
)
def junk_rows(part):
    """Rows whose name begins with a digit, or is no name (FLT6, FLT12)."""
    return part.select(
        "p_partkey", F.col("p_name").rlike("^[0-9]").alias("digit_first"), filters.is_junk_name("p_name").alias("junk")
    )


@query(
    "orders",
    sql="""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS done,
    coalesce(CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END, 0) AS done_or_zero,
    (CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END IS NULL OR o_orderstatus = 'O') AS open FROM orders""",
)
def tri_state_flags(orders):
    """A flag with three states: one, zero and unknown (FLT14, FLT15)."""
    done = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return orders.select(
        "o_orderkey",
        done.alias("done"),
        F.coalesce(done, F.lit(0)).alias("done_or_zero"),
        (done.isNull() | (done == 0)).alias("open"),
    )


@query(
    "documents",
    sql=r"""SELECT doc_id, CASE WHEN text ILIKE '%license%' THEN 'legal' WHEN text ILIKE '%the %' THEN 'english'
    WHEN text ILIKE '%der %' OR text ILIKE '%und %' THEN 'german' ELSE 'other' END AS category,
    (text ILIKE '%license%' OR text ILIKE '%copyright%') AS mentions FROM documents""",
)
def first_match_category(documents):
    """The first category whose keywords a text has, and whether it has any of a list (FLT16, FLT17)."""
    rules = [("legal", ["license"]), ("english", ["the "]), ("german", ["der ", "und "])]
    return documents.select(
        "doc_id",
        filters.first_category("text", rules, "other").alias("category"),
        filters.contains_any("text", ["license", "copyright"]).alias("mentions"),
    )


@query(
    "events",
    sql="""SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'moderate' WHEN value < 100 THEN 'high' ELSE 'extreme' END AS level FROM events""",
)
def threshold_levels(events):
    """A value as a named level (FLT18)."""
    return events.select(
        "event_id", filters.level("value", [(10, "low"), (50, "moderate"), (100, "high")], "extreme").alias("level")
    )


@query(
    "customer",
    sql=r"""SELECT c_custkey, regexp_matches(c_name, '^[A-Z][a-z''-]+( [A-Z][a-z''.-]*)+$') AND NOT regexp_matches(lower(c_name), '\b(chair|clerk|mayor|speaker|resident)\b') AS person FROM customer""",
)
def person_names(customer):
    """Whether a name is a person's (FLT19)."""
    return customer.select("c_custkey", filters.is_person_name("c_name").alias("person"))


# ---- order, pages and sets --------------------------------------------------------------------------------


@query(
    "orders",
    sql="SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 20",
)
def top_orders(orders):
    """The largest rows under a mixed order (SRT1, SRT2, SRT9)."""
    return (
        orders.select("o_orderkey", "o_totalprice", "o_orderdate")
        .orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
        .limit(20)
    )


@query(
    "orders",
    "customer",
    sql="""SELECT c_custkey, last_order, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = '' THEN 1 ELSE 0 END, last_order NULLS LAST, c_custkey) AS place
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders WHERE o_orderdate >= TIMESTAMP '2001-03-01' GROUP BY 1) o ON c_custkey = o_custkey
    ORDER BY place LIMIT 100""",
)
def nulls_last_order(orders, customer):
    """Empty or missing values sorted last, the first hundred (SRT3, SRT4, SRT5)."""
    last = orders.where("o_orderdate >= timestamp '2001-03-01'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    joined = customer.join(last, customer.c_custkey == last.o_custkey, "left")
    keys = [F.when(F.col("c_mktsegment") == "", 1).otherwise(0), F.asc_nulls_last("last_order"), F.asc("c_custkey")]
    return paging.numbered_top(joined, keys, 100).select("c_custkey", "last_order", F.col("place").cast("bigint").alias("place"))


@query(
    "part",
    sql="""SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, (SELECT ceil(count(*) / 24.0)::BIGINT FROM part) AS pages, 3::BIGINT AS page
    FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 24 OFFSET 48""",
)
def page_with_total(part):
    """One page of a sorted listing with total, number of pages and the page clamped (SRT6, SRT7, MTH4)."""
    return paging.page(part, "price", page=3, size=24).select("p_partkey", "p_name", "total", "pages", "page")


@query(
    "conversations",
    sql="""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r <= 3""",
)
def longest_turns(conversations):
    """The longest members of each group in their own order (SRT10)."""
    longest = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    return conversations.withColumn("r", F.row_number().over(longest)).where("r <= 3").select("conv_id", "turn", "text")


@query(
    "documents",
    sql="""WITH s AS (SELECT doc_id, source, (text ILIKE '%license%')::INT * 5 + (text ILIKE '%the %')::INT * 2 + (length(text) > 1000)::INT AS score FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM s)
    SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) FILTER (WHERE rn <= 3) || CASE WHEN max(n) > 3 THEN ' plus ' || (max(n) - 3) || ' more' ELSE '' END AS listing
    FROM r GROUP BY 1""",
)
def scored_listing(documents):
    """Best three of each group by summed keyword weights, and how many more (SRT11)."""
    weights = [("license", 5), ("the ", 2)]
    score = sum((F.col("text").ilike(f"%{w}%").cast("int") * n for w, n in weights), (F.length("text") > 1000).cast("int"))
    return paging.best_and_rest(documents.withColumn("score", score), "source", "score", "doc_id", 3)


@query(
    "documents",
    sql="""SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 20000""",
)
def budgeted_prefix(documents):
    """Documents of each group until a budget of characters is used (SRT12)."""
    sized = documents.select("source", "doc_id", F.length("text").cast("bigint").alias("chars"))
    used = windows.running_sum(sized, "source", "doc_id", "chars", "used")
    return used.where("used <= 20000").select("source", "doc_id")


@query(
    "orders",
    sql="""WITH recent AS (SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY),
    latest AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10)
    SELECT o_orderkey FROM recent UNION ALL SELECT o_orderkey FROM latest WHERE NOT EXISTS (SELECT 1 FROM recent)""",
)
def fallback_if_empty(orders):
    """A second result set if the first is empty (SRT13)."""
    last = orders.agg(F.max("o_orderdate").alias("last"))
    recent = orders.join(F.broadcast(last)).where(F.col("o_orderdate") > F.col("last") + F.expr("INTERVAL 1 DAY")).select("o_orderkey")
    latest = orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey")
    return sets.first_not_empty([recent, latest])


@query(
    "orders",
    sql="""WITH u AS (SELECT o_orderkey, o_totalprice, 0 AS priority FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, -o_totalprice, 1 FROM orders WHERE o_totalprice > 100000)
    SELECT o_orderkey, o_totalprice FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority) = 1""",
)
def union_priority_dedup(orders):
    """Two lists as one, the first list's row winning for a key (SET2, SET6, WIN13)."""
    first = orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    second = orders.where("o_totalprice > 100000").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return sets.union_first_wins([first, second], ["o_orderkey"])


@query(
    "documents",
    "labels",
    sql="""SELECT 'only documents' AS part, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""",
)
def set_operations(documents, labels):
    """Sizes of difference, intersection and union of two key sets (SET1, SET3, SET4, SET5)."""
    left = documents.select("doc_id", F.lit(1).alias("a"))
    both = left.unionByName(labels.select("doc_id", F.lit(2).alias("a"))).groupBy("doc_id").agg(F.bit_or("a").alias("a"))
    counts = both.agg(
        F.count_if(F.col("a") == 1).alias("only documents"), F.count_if(F.col("a") == 3).alias("both"), F.count("*").alias("either")
    )
    return counts.unpivot([], ["only documents", "both", "either"], "part", "n")
