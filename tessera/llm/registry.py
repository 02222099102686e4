"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from tessera.llm import ann, bpe, conversations, html_extract, langid, license_scan, line_dedup, mixing, quality_model, quality_rules, simhash, token_align, url_filter


def queries() -> dict[str, Callable]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_bpe": bpe.op3_bpe,
        "op4_language_id": langid.op4_language_id,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_quality": quality_model.op6_quality,
        "op7_html": html_extract.op7_html,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_mixing": mixing.op9_mixing,
        "op10_ann": ann.op10_ann,
        "op11_conversations": conversations.op11_conversations,
        "op12_token_align": token_align.op12_token_align,
        "op13_url_filter": url_filter.op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op11_conversations": conversations.ORACLE, "op13_url_filter": url_filter.ORACLE}
