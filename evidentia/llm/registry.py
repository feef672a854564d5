"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from evidentia.llm import bpe, chat, langid, licences, mixing, neardup, neighbours, periodic, prefixes, quality, sharding, topk, toxicity


def queries() -> dict[str, Callable]:
    return {
        "op1_license_scan": licences.op1_license_scan,
        "op2_nearest": neighbours.op2_nearest,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_near_duplicates": neardup.op4_near_duplicates,
        "op5_bpe": bpe.op5_bpe,
        "op6_language_id": langid.op6_language_id,
        "op7_sharding": sharding.op7_sharding,
        "op8_top_scores": topk.op8_top_scores,
        "op9_mixing": mixing.op9_mixing,
        "op10_chat_format": chat.op10_chat_format,
        "op11_prefix_trie": prefixes.op11_prefix_trie,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_quality_rules": quality.op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licences.SQL_LICENCES,
        "op2_nearest": neighbours.SQL_NEAREST,
        "op8_top_scores": topk.SQL_TOP,
        "op9_mixing": mixing.SQL_MIXING,
        "op10_chat_format": chat.SQL_CHAT,
        "op11_prefix_trie": prefixes.SQL_TRIE,
        "op12_periodic_runs": periodic.SQL_RUNS,
        "op13_quality_rules": quality.SQL_QUALITY,
    }
