"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontamination, html_text, lm_scoring, mixing, periodic_runs, quality_model, quality_rules, secret_scan, simhash, substrings, token_alignment,
    tokens, url_rules)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    """Words of every document that stand in a ten-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontamination.n_hit().alias("n_hit"),
                        F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                        (F.size("hit_items") > 0).alias("contaminated"))


def op2_quality(spark, sf_dir):
    """Quality score of every document, learned from labels of other documents."""
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_main_text(spark, sf_dir):
    """Main text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op4_token_counts(spark, sf_dir):
    """Tokens of every document by the 50k byte-level vocabulary."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary_path("byte_bpe_50k.json"))


def op5_substring_dedup(spark, sf_dir):
    """Every document without the words of 13-word windows that start in an earlier document too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = substrings.deduplicated(docs, keep_layout=False)
    return clean.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.grouped(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_rules(spark, sf_dir):
    """Verdict on the URL of every page."""
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark, sf_dir):
    """Counts and verdict of every document under adaptive thresholds per language and source."""
    return quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm_score(spark, sf_dir):
    """Unigram and context-mixing log probability of every document."""
    scored = lm_scoring.scored(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_mix(spark, sf_dir):
    """Words that a mix of all sources takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mixed(docs, keep_text=False)
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def op11_secrets(spark, sf_dir):
    """Secrets in every document: those of the base patterns and those that belong to one source alone."""
    found = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", *(secret_scan.n_of(k).alias(f"n_{k}") for k in secret_scan.BASE), F.sha2(secret_scan.base_spans(), 256).alias("base_sha256"),
                        secret_scan.all_spans().alias("spans"), "n_copied", "n_specific")


def op12_token_alignment(spark, sf_dir):
    """Alignment of every document's tokens by a byte-level and by a piece vocabulary."""
    return token_alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.vocabulary_path("byte_bpe_50k.json"),
                                   tokens.vocabulary_path("piece_bpe_32k.model"))


def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, after one document in ten was made periodic."""
    found = periodic_runs.collapsed(table(spark, sf_dir, "documents"), rearranged=periodic_runs.planted)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    best = found.withColumn("r", F.when(F.size("runs") > 0, longest))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period",
                       F.expr("1000 * r.length div r.period").alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))



QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality, op3_main_text, op4_token_counts, op5_substring_dedup, op6_simhash, op7_url_rules, op8_quality_rules, op9_lm_score,
    op10_mix, op11_secrets, op12_token_alignment, op13_periodic_runs)}
