"""Registered queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from trustlake.llm import ann, decontamination, html_extraction, katz_lm, language_id, merkle, minhash_dedup, mixing, packing, quality, substring_dedup, warc, whitening


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_html_extraction": html_extraction.op3_html_extraction,
        "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
        "op5_katz_lm": katz_lm.op5_katz_lm,
        "op6_ann": ann.op6_ann,
        "op7_quality": quality.op7_quality,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_language_id": language_id.op9_language_id,
        "op10_warc": warc.op10_warc,
        "op11_whitening": whitening.op11_whitening,
        "op12_merkle": merkle.op12_merkle,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op10_warc": warc.ORACLE,
        "op12_merkle": merkle.ORACLE,
    }
