"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "decontaminate", "bpe", "warc", "quality", "language", "pii", "embeddings", "relative_lz", "suffix_array", "importance", "lines", "prefix_trie")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"gridloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
