"""The queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import blob_ledger, block_anchors, bwt_merge, decontam, host_suffix, langid, late_overwrite, line_quality, line_templates, ngram_join, piece_viterbi, source_audit, toxicity
from .common import table
from .oracles import ORACLES  # noqa: F401


def op1_boosted_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_wand_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_adaptive_prefix_join(spark, sf_dir):
    return ngram_join.link_report(table(spark, sf_dir, "documents"))


def op4_log_template_lines(spark, sf_dir):
    return line_templates.dedup_report(table(spark, sf_dir, "documents"))


def op5_line_frequency_quality(spark, sf_dir):
    return line_quality.quality_report(table(spark, sf_dir, "documents"))


def op6_host_suffix_text(spark, sf_dir):
    return host_suffix.page_report(table(spark, sf_dir, "pages"))


def op7_blob_ledger_secrets(spark, sf_dir):
    return blob_ledger.secret_report(table(spark, sf_dir, "documents"))


def op8_subword_language(spark, sf_dir):
    return langid.language_report(table(spark, sf_dir, "documents"))


def op9_block_anchor_repeats(spark, sf_dir):
    return block_anchors.removal_report(table(spark, sf_dir, "documents"))


def op10_piece_viterbi_tokens(spark, sf_dir):
    return piece_viterbi.token_report(table(spark, sf_dir, "documents"))


def op11_late_day_overwrite(spark, sf_dir):
    return late_overwrite.overwrite_report(table(spark, sf_dir, "sales"))


def op12_sketched_source_audit(spark, sf_dir):
    return source_audit.divergences(table(spark, sf_dir, "documents"))


def op13_bwt_merge_repeats(spark, sf_dir):
    return bwt_merge.repeat_report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_boosted_toxicity,
        op2_wand_decontamination,
        op3_adaptive_prefix_join,
        op4_log_template_lines,
        op5_line_frequency_quality,
        op6_host_suffix_text,
        op7_blob_ledger_secrets,
        op8_subword_language,
        op9_block_anchor_repeats,
        op10_piece_viterbi_tokens,
        op11_late_day_overwrite,
        op12_sketched_source_audit,
        op13_bwt_merge_repeats,
    )
}
