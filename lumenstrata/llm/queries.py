"""The operators on the driver's tables, with production parameters."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, html_extract, langid, ngram_join, pieces, pii, quality, substring_dedup, suffix_dedup, token_align, token_rollup, toxicity
from .common import held_out, materialize, scratch_path, table
from .oracles import ORACLE_SQL

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("LUMENSTRATA_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"
BPE_JSON = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer's pattern that goes with the rank file, as its library publishes it.
BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit_from_table(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)), F.sha2(pii.spell(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.spell(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ranges = F.col("hit_ranges")
    n_hit = F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_pieces(docs, f"{TOKENIZERS}/{PIECE_MODEL}")
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.get("nbest_scores", F.lit(0)).alias("score"), "nbest_scores", "round_trip", "piece_ids")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.evaluate_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = ledger["rule_bits"].bitwiseAND(F.lit(quality.BASE_BITS).cast("long")) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality.passes(F.col("rule_bits")).alias("kept"), "rule_bits")


def ablation_of_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and beside the others."""
    return quality.ablation(quality.evaluate_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("rule_bits"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = f"{TOKENIZERS}/{BPE_RANKS}"
    counters = {"byte_bpe_50k": lambda: token_rollup.BpeCounter(ranks, BPE_PATTERN), "words": lambda: token_rollup.count_words}
    docs = table(spark, sf_dir, "documents")
    arrived = docs.select("doc_id", "source", "lang", F.explode(F.array(*map(F.lit, counters))).alias("version"), F.lit(0).cast("long").alias("n_tokens"), F.lit("insert").alias("op"))
    counts = materialize(token_rollup.count_tokens(docs, counters), "counts")
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"), fan_in=2)
    rollup.commit("arrive", arrived.filter("doc_id is not null"))  # documents are entered as they arrive,
    counted = counts.withColumn("op", F.lit("insert"))
    rollup.commit("count", counted)  # and revised when they are counted
    rollup.commit("count", counted)  # a repeated commit changes nothing
    empty = counts.filter("doc_id is not null").groupBy("doc_id", "version").agg(F.sum("n_tokens").alias("n_tokens")).filter("n_tokens = 0")
    null = F.lit(None).cast("string")
    rollup.commit("withdraw", empty.select("doc_id", null.alias("source"), null.alias("lang"), "version", "n_tokens", F.lit("delete").alias("op")))  # documents without a token go
    return rollup.totals().select("source", "lang", F.col("version").alias("tokenizer_version"), "n_docs", "n_tokens")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, final = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = F.array(*map(F.lit, centroids.centroid_digests(final))) if len(final) else F.array().cast("array<string>")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.get(digests, F.col("cluster")).alias("centroid_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_earlier_bytes(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = f"{TOKENIZERS}/{PIECE_MODEL}"
    make_a, make_b = partial(token_align.ByteBpe, f"{TOKENIZERS}/{BPE_JSON}", BPE_PATTERN), partial(token_align.Pieces, model)
    out = token_align.link_figures(table(spark, sf_dir, "documents").select("doc_id", "text"), make_a, make_b, token_align.Pieces(model).size)
    return out.withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_language_id, op2_pii, op3_decontamination, op4_sentencepiece, op5_ngram_join, op6_toxicity, op7_quality_rules, op8_token_counts, op9_substring_dedup, op10_html_extraction, op11_centroid_clustering, op12_suffix_dedup, op13_token_alignment, pipeline, ablation_of_quality_rules)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
