"""Queries of the numbered operators and of the pipeline, and the SQL that some of them equal."""

from __future__ import annotations

import corpus_pipeline
from tallyspan.llm import bpe, chat, collocations, exact_dedup, hard_negatives, html_text, language_id, mixing, ngram_join, pii, quality_rules, recurrent_lm, sstable


def queries() -> dict:
    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_recurrent_lm": recurrent_lm.op3_recurrent_lm,
        "op4_bpe_encode_decode": bpe.op4_bpe_encode_decode,
        "op5_language_id": language_id.op5_language_id,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_mixing": mixing.op8_mixing,
        "op9_html_text": html_text.op9_html_text,
        "op10_sstable": sstable.op10_sstable,
        "op11_collocations": collocations.op11_collocations,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_chat_format": chat.op13_chat_format,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_exact_dedup": exact_dedup.SQL, "op11_collocations": collocations.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_chat_format": chat.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
