"""The registered queries of the operators: operator results reduced to the contracted columns."""

from pyspark.sql import functions as F

from ledgerlark.io import load

from . import byte_pairs, chat_format, decontaminate, divergence, flac, html_text, line_dedup, ngram_lm, phrases, pieces, quality, simhash, toxicity

#: A public SentencePiece model; any other path can be given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Of the public rank files the one that byte-level BPE takes by default.
RANKS = "byte_bpe_50k.tiktoken"


def op5_line_dedup(spark, sf_dir):
    """Lines dropped per document, with the digest of what stays."""
    kept = line_dedup.keep_bitmaps(load(spark, sf_dir, "documents").select("doc_id", "text"))
    text = line_dedup.kept_text(F.coalesce("text", F.lit("")), F.col("keep_bitmap"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op7_decontamination(spark, sf_dir):
    """Benchmark words and items found in each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_chat_format(spark, sf_dir):
    """All conversations formatted, and what is read back from the rendering."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(trap).alias("text"))
    turns = turns.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])).withColumn("content", chat_format.text_content(F.col("text")))
    chats = chat_format.format_chats(turns.select("conv_id", "turn", "role", "content"))
    read = chats.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn(
        "loss", chat_format.read_loss_text(F.col("formatted"), F.col("spans"))
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = simhash.near_components(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _fold(modulus):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op6_quality(spark, sf_dir):
    """Quality score of every document; every third row is held out from training."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, load(spark, sf_dir, "labels"), _fold(3) != 1)
    held_out = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return quality.quality_scores(docs, model).select("doc_id", held_out, "score", "predicted")


def op9_toxicity(spark, sf_dir):
    """Toxicity score of every document; every fifth row is held out from training."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), _fold(5) != 0)
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out, "score", "predicted")


def op4_media(spark, sf_dir):
    """Every document as a FLAC file, and what the file holds when read back."""
    stored = flac.to_media(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return flac.read_back(stored)


def op1_sentencepiece(spark, sf_dir, model_path=MODEL_PATH):
    """Ids of every document, and whether they give back its text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, pieces.read_model(model_path))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "n_tokens", "ids", same.alias("round_trip"), "parity")


def op2_html_extract(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_lm_score(spark, sf_dir):
    """Log probability of every document under a bigram model of six sevenths of them."""
    return ngram_lm.score(load(spark, sf_dir, "documents").select("doc_id", "text"), _fold(7) != 2)


def op11_collocations(spark, sf_dir):
    """The first 2000 phrases of each language whose words belong together most."""
    return phrases.collocations(load(spark, sf_dir, "documents").select("text", "lang"))


def op12_byte_bpe(spark, sf_dir, ranks_path=None):
    """Digests of every document's byte-level BPE ids and of the bytes that they give back."""
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_pairs.encode(docs, byte_pairs.read_ranks(ranks_path or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return coded.select("doc_id", "n_tokens", *digests)


def op13_divergence(spark, sf_dir):
    """How far the sources of each language are apart, and the terms that tell a source from its language."""
    return divergence.audit(load(spark, sf_dir, "documents").select("text", "lang", "source"))
