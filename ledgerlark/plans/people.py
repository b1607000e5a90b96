"""Queries on names and on what quality gates say of texts."""

from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import gates, names
from ledgerlark.operators.materialise import written

from .registry import query


def _spoken(conversations):
    """Turns with words that show who speaks: made from the role and the first word of each turn."""
    first = F.initcap(F.regexp_extract("text", r"(\p{L}{3,})", 1))
    said = F.concat(F.lit("Thank you, "), first, F.lit(". I'm "), first, F.lit(". "), F.col("text"))
    return conversations.select("conv_id", "turn", "role", first.alias("first"), said.alias("said"))


@query("conversations")
def evident_speakers(conversations):
    """Known names of which speech gives evidence (ETL4, ETL5)."""
    spoken = _spoken(conversations)
    known = spoken.select(F.concat("first", F.lit(" Kind")).alias("name")).distinct()
    return names.evident_speakers(spoken, "conv_id", "said", known, "name").select("conv_id", "name", F.array_join("kinds", ",").alias("kinds"))


@query("part")
def majority_spellings(part):
    """Rarer spellings mapped to the frequent one that they are like (AGG16)."""
    third = F.col("p_partkey") % 17 == 0
    spelled = part.select(F.when(third, F.regexp_replace("p_name", "l", "ll")).otherwise(F.col("p_name")).alias("name"))
    return names.majority_spellings(spelled, "name", 0.9)


@query("part")
def corrected_names(part):
    """Misspelled and titled names with the canonical one that is meant (ETL6, JN16)."""
    asked = part.select(F.concat(F.lit("Mayor "), F.regexp_replace("p_name", "t", "tt")).alias("name")).union(part.select(F.col("p_name").alias("name")))
    canonical = part.select(F.col("p_name").alias("name"), F.lit(True).alias("official")).distinct()
    return names.corrected_names(asked, canonical, "name", "official").select("name", "best", F.round("score", 6).alias("score"), "method")


@query("documents", "part")
def key_terms(documents, part):
    """Terms to listen for, from four lists in order, a top-100 report (ETL7)."""
    entities = part.groupBy(F.initcap("p_name").alias("name")).agg(F.count("*").alias("mentions"))
    return names.key_terms(["Old Post Road", "Harbor"], documents, "doc_id", "doc_id", "text", entities, "name", "mentions")


@query(
    "part",
    "documents",
    sql=r"""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part), t AS (SELECT ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents)
    SELECT name, EXISTS (SELECT 1 FROM t WHERE contains(t, ' ' || name || ' ')) AS verified FROM n""",
)
def verified_entities(part, documents):
    """Names that an authoritative text has (GRA10)."""
    entities = part.select(F.split("p_name", " ")[0].alias("name")).distinct()
    return names.verified(entities, "name", documents, "text")


@query("documents")
def spelling_corrections(documents):
    """Capitalised words and phrases that are nearly a frequent one, and the texts with them put right (STR26)."""
    words = documents.select(F.explode(text.all_matches(F.col("text"), r"\b[A-Z][a-z]{3,}\b")).alias("word"))
    several = names.phrase_spellings(documents, "text", 20)
    frequent = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 20").select("word").union(several.select("phrase"))
    found = written(names.corrections(documents, "doc_id", "text", frequent, "word"))
    fixed = names.corrected_text(documents, "doc_id", "text", found)
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" > ", "wrong", "right"))), ", ").alias("pairs")
    return found.groupBy("doc_id").agg(pairs).join(fixed.select("doc_id", F.md5("text").alias("digest")), "doc_id")


def _timed(conversations):
    start = F.col("turn") * 20.0
    speaker = F.when(F.col("role") == "user", "Ann Li").when(F.col("role") == "assistant", "Bo Chu").otherwise("Ralph")
    return conversations.select("conv_id", F.col("turn").alias("n"), speaker.alias("speaker"), start.alias("start"), (start + 15.0).alias("end"), "text")


def _quotes(conversations):
    at = F.col("turn") * 20.0 + F.when(F.col("turn") % 2 == 0, 4.0).otherwise(90.0)
    who = F.when(F.col("conv_id") % 2 == 0, "Trustee Li").otherwise("Cy Dee")
    key = F.format_string("%d-%d", F.col("conv_id"), F.col("turn"))
    quote = F.array_join(F.slice(text.words(F.col("text")), 1, 8), " ")
    return conversations.select("conv_id", key.alias("q"), at.alias("at"), who.alias("attrib"), quote.alias("quote"))


@query("conversations")
def attributed_quotes(conversations):
    """Whether the one a quote is attributed to speaks there (DQ4, DQ5)."""
    found = gates.attributed(_quotes(conversations), _timed(conversations), "conv_id")
    return found.select("q", "ok", F.array_join("speakers", ",").alias("speakers"))


@query("conversations")
def repaired_times(conversations):
    """Times of quotes moved to the turn that they are from (DQ11)."""
    return gates.repaired_times(_quotes(conversations), _timed(conversations).select("conv_id", "start", "text"), "conv_id").select("q", "at", "fixed")


@query(
    "conversations",
    sql="""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'not in pool' ELSE 'match' END AS reason FROM conversations WHERE text IS NOT NULL""",
)
def quotes_at_times(conversations):
    """Whether the text at a time agrees with a quote (DQ10)."""
    pool = conversations.select("conv_id", F.col("turn").alias("at"), "text")
    part = F.array_join(F.slice(text.words(F.col("text")), 1, 6), " ")
    quotes = conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, -1).otherwise(F.col("turn")).alias("at"), part.alias("quote"))
    return gates.quote_at(quotes, pool, "conv_id").select("conv_id", "turn", "reason")


@query("conversations", "documents")
def name_provenance(conversations, documents):
    """Where a text's names are from (DQ6, DQ8)."""
    spoken = _spoken(conversations)
    asked = spoken.select("conv_id", F.concat("first", F.lit(" "), F.col("role")).alias("name"))
    own = spoken.select("conv_id", F.concat_ws(" ", F.col("first"), F.col("role"), F.col("said")).alias("text"), (F.col("conv_id") % 2 == 0).alias("has_minutes"))
    labels = asked.where("conv_id % 3 = 0").select("conv_id", F.col("name").alias("label"))
    return gates.name_provenance(asked, own, labels, documents.select("text"), "conv_id")


@query(
    "documents",
    "labels",
    sql="""SELECT doc_id, '1:' || doc_id AS reference FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def dead_references(documents, labels):
    """Markers whose file isn't there (DQ17)."""
    number = F.col("doc_id").cast("string")
    marked = documents.withColumn("text", F.concat(F.col("text"), F.lit(" {{photo:1:"), number, F.lit(":a caption}}")))
    there = labels.select(F.concat(F.lit("1:"), number).alias("file"))
    return gates.dead_references(marked, "doc_id", "text", there, "file")


@query(
    "documents",
    sql="""WITH d AS (SELECT doc_id, (doc_id % 10 + 1) || ' Old Post Road' AS address FROM documents WHERE doc_id % 3 = 0),
    w AS (SELECT *, list_concat(list(doc_id) OVER (PARTITION BY address ORDER BY doc_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), list(doc_id) OVER (PARTITION BY address ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) AS o FROM d)
    SELECT doc_id, address, array_to_string(o[1:5], ',') AS others FROM w WHERE len(o) > 0""",
)
def shared_addresses(documents):
    """Other documents with an address of a document (JN23): every third document gets one of ten addresses."""
    place = F.concat(F.lit(" at "), (F.col("doc_id") % 10 + 1).cast("string"), F.lit(" Old Post Road"))
    marked = documents.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", place)).otherwise(F.col("text")))
    found = gates.shared_addresses(marked, "doc_id", "text")
    return found.select("doc_id", "address", F.array_join(F.transform("others", lambda o: o.cast("string")), ",").alias("others"))
