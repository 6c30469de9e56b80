"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import arc_warc, containment, crf_language, line_dedup, mixing, mpeg_audio, near_dedup, substring_index, token_store, url_reputation


def queries() -> dict:
    return {
        "op1_url_reputation": url_reputation.op1_url_reputation,
        "op2_containment": containment.op2_containment,
        "op3_mpeg_audio": mpeg_audio.op3_mpeg_audio,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_crf_language": crf_language.op5_crf_language,
        "op6_substring_index": substring_index.op6_substring_index,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_arc_warc": arc_warc.op8_arc_warc,
        "op9_token_store": token_store.op9_token_store,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict:
    return {
        "op1_url_reputation": url_reputation.ORACLE,
        "op2_containment": containment.ORACLE,
        "op4_near_dedup": near_dedup.ORACLE,
        "op6_substring_index": substring_index.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op8_arc_warc": arc_warc.ORACLE,
        "op10_mixing": mixing.ORACLE,
    }
