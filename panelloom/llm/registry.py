"""All queries of this subpackage."""

from __future__ import annotations

from panelloom.llm import chat, decontamination, embedding, infill, lines, mixing, packing, pii, quality, sharding, simhash, substring, trie

_MODULES = (lines, quality, chat, mixing, sharding, embedding, packing, pii, simhash, substring, infill, decontamination, trie)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.oracle_sql().items()}
