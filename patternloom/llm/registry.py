"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, jaccard_join, language_id, mixing, sharding, substring_dedup, token_files, warc

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_language_id": language_id.op2_language_id,
    "op3_sharding": sharding.op3_sharding,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_token_files": token_files.op6_token_files,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op1_jaccard_join": jaccard_join.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_warc": warc.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
