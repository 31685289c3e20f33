"""The queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from harborscan.llm import byte_bpe, decontamination, html_text, license_scan, ngram_join, oracles, prefix_trie, quality_rules, resampling, revisits, secret_scan, token_counts, token_store, toxicity
from harborscan.llm.common import table


def op1_benchmark_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark, sf_dir):
    return token_counts.counted(table(spark, sf_dir, "documents"), token_counts.load_scores(public_tokenizers.path("piece_bpe_32k.model")))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_store(spark, sf_dir):
    return token_store.stored_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.tokens(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_secret_scans(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark, sf_dir):
    return revisits.resolved(revisits.captures(table(spark, sf_dir, "pages")))


def op8_html_extraction(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark, sf_dir):
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scans(spark, sf_dir):
    return license_scan.licensed(table(spark, sf_dir, "documents")).drop("notices")


def queries():
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_token_counts, op3_quality_rules, op4_token_store, op5_byte_bpe, op6_secret_scans, op7_warc_revisits, op8_html_extraction, op9_toxicity, op10_ngram_jaccard_join, op11_prefix_trie, op12_importance_resampling, op13_license_scans)}


def oracle_sql():
    return {"op1_benchmark_decontamination": oracles.DECONTAMINATION, "op3_quality_rules": oracles.QUALITY, "op7_warc_revisits": revisits.ORACLE, "op10_ngram_jaccard_join": oracles.NGRAM_JOIN, "op11_prefix_trie": prefix_trie.ORACLE}
