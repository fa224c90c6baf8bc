"""Queries of the corpus operators, with the SQL that expresses them where there is such SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, lines, lm, media, pieces, pii, quality, secrets, simhash, tokenids


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1,
        "op2_decontamination": decontaminate.op2,
        "op3_sentencepiece": pieces.op3,
        "op4_quality": quality.op4,
        "op5_secrets": secrets.op5,
        "op6_token_ids": tokenids.op6,
        "op7_media": media.op7,
        "op8_lm": lm.op8,
        "op10_pii": pii.op10,
        "op9_simhash": simhash.op9,
    }


def oracle_sql() -> dict[str, str]:
    return {}
