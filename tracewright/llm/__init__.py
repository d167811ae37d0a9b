"""Operators for training-data pipelines, each with its query; nothing else in the package imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("alignment", "chat_format", "curve_packing", "divergence", "fill_in_middle", "language_id", "link_trust", "mixing", "sentencepiece_codec", "sharding", "simhash", "spotsigs", "substrings")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
