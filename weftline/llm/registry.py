"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, langid, lines, mixing, packing, quality, rindex, secrets, spotsigs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_language_id": langid.op3_language_id,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_suffix_dedup": rindex.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_spot_signatures": spotsigs.op10_spot_signatures,
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality.sql(),
    "op2_chat_formatting": chat.sql(),
    "op5_source_mixing": mixing.sql(),
    "op6_secret_scan": secrets.sql(),
    "op9_line_dedup": lines.sql(),
}
