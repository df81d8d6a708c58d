"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tidewater.llm import bpe, chat, convnet, kneser, licences, lines, packing, repair, rules, simhash, sketch, topk, variants


def queries() -> dict:
    return {
        "op1_quality_rules": rules.op1_quality_rules,
        "op2_packing": packing.op2_packing,
        "op3_quality_classifier": convnet.op3_quality_classifier,
        "op4_bpe": bpe.op4_bpe,
        "op5_simhash": simhash.op5_simhash,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_fingerprints": sketch.op7_fingerprints,
        "op8_chat_format": chat.op8_chat_format,
        "op9_license_scan": licences.op9_license_scan,
        "op10_lm_score": kneser.op10_lm_score,
        "op11_variants": variants.op11_variants,
        "op12_top_k": topk.op12_top_k,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": chat.ORACLE, "op12_top_k": topk.ORACLE}
