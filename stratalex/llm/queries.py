"""The subpackage's queries, each over its whole table, and the SQL that must return the same rows."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, language, licenses, lines, mixing, neardup, passages, secrets
from .common import table


def queries() -> dict:
    return {
        "op1_license_scan": lambda spark, d: licenses.scan(table(spark, d, "documents")),
        "op2_chat_rotation": lambda spark, d: chat.rotate(table(spark, d, "conversations")),
        "op3_decontamination": lambda spark, d: decontaminate.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op4_fingerprints": lambda spark, d: fingerprint.edited_likeness(table(spark, d, "documents")),
        "op5_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
        "op6_line_dedup": lambda spark, d: lines.report(table(spark, d, "documents")),
        "op7_secret_scan": lambda spark, d: secrets.scan(table(spark, d, "documents")),
        "op8_substring_dedup": lambda spark, d: passages.dedup_passages(table(spark, d, "documents")),
        "op9_near_duplicates": lambda spark, d: neardup.components(table(spark, d, "documents")),
        "op10_language_id": lambda spark, d: language.identify(table(spark, d, "documents")),
    }
