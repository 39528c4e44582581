"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, lines, packing, quality, simhash, substrings, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_urls": urls.op2_urls,
        "op3_lines": lines.op3_lines,
        "op4_simhash": simhash.op4_simhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_chat": chat.op7_chat,
        "op8_warc": warc.op8_warc,
        "op9_substrings": substrings.op9_substrings,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_urls": urls.OP2_SQL,
        "op3_lines": lines.OP3_SQL,
        "op6_quality": quality.OP6_SQL,
        "op7_chat": chat.OP7_SQL,
        "op9_substrings": substrings.OP9_SQL,
        "op10_decontamination": decontamination.OP10_SQL,
    }
