"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lexigrid.llm import bpe, decontaminate, html_extract, language_id, quality, secrets, simhash, substring_dedup, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_warc": warc.op10_warc,
}
ORACLES: dict[str, str] = {"op4_quality_rules": quality.ORACLE, "op5_decontamination": decontaminate.ORACLE, "op10_warc": warc.ORACLE}
