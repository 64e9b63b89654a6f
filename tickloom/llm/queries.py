"""The registered queries of this subpackage and their SQL: (spark, sf_dir) -> DataFrame."""

from pyspark.sql import functions as F

from tickloom.llm import (
    additive, chat, context_mixing, hard_negatives, languages, mixing, overlap_join, phrases, rules, secret_scan, token_files,
    warc, whitening,
)
from tickloom.llm.common import table
from tickloom.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {}


def register(build):
    QUERIES[build.__name__] = build
    return build


@register
def op1_warc(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op2_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe_turns(spark))
    out = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = out.select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@register
def op3_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrases.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register
def op4_quality_rules(spark, sf_dir):
    # the cascade decides; the measures, which the query returns for every row, are added here
    judged = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = rules.measures(judged.select("row.doc_id", "row.text", F.col("rejected_by").isNull().alias("kept")))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), "kept")


@register
def op6_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@register
def op5_language_mixture(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@register
def op7_token_ids(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


@register
def op8_quality_classifier(spark, sf_dir):
    found = additive.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@register
def op9_jaccard_join(spark, sf_dir):
    found = overlap_join.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@register
def op10_context_mixing(spark, sf_dir):
    found = context_mixing.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op11_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


@register
def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


@register
def op13_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id", *[secret_scan.span_count(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))
