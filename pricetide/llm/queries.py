"""All registered queries of this subpackage, and their SQL where SQL can express them."""

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in ("q_tokens", "q_dedup", "q_chat", "q_vectors", "q_media", "q_models", "q_audit", "q_align"):
    _module = import_module(f"pricetide.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
