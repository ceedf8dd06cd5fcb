"""The registered queries of this package: one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import ann, bpe_codec, chat, collocations, decontaminate, html_text, lm_score, near_dup, oracles, packing, pii, quality, resampling, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_near_dup": near_dup.op2_near_dup,
        "op3_quality": quality.op3_quality,
        "op4_pii": pii.op4_pii,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_chat_windows": chat.op6_chat_windows,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_packing": packing.op8_packing,
        "op9_ann": ann.op9_ann,
        "op10_html_text": html_text.op10_html_text,
        "op11_collocations": collocations.op11_collocations,
        "op12_resampling": resampling.op12_resampling,
        "op13_bpe_codec": bpe_codec.op13_bpe_codec,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dup": oracles.NEAR_DUP,
        "op6_chat_windows": oracles.CHAT,
        "op7_decontaminate": oracles.DECONTAMINATE,
        "op11_collocations": oracles.COLLOCATIONS,
        "op12_resampling": oracles.RESAMPLING,
    }
