"""The registered queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, chat, decontam, html, langid, licenses, linededup, quality, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_line_dedup": linededup.op2_line_dedup,
        "op3_language_id": langid.op3_language_id,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_html_text": html.op5_html_text,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_chat_format": chat.op7_chat_format,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_bpe": bpe.op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.ORACLE, "op7_chat_format": chat.ORACLE}
