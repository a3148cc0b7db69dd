"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("toxicity", "packing", "kneser_ney", "minhash_dedup", "secret_scan", "topk_search", "warc_index", "byte_bpe", "audio_features", "language_id", "sharding", "phrases", "turn_repair")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"sluice.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
