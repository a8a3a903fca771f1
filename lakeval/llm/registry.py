"""Queries of this subpackage and their SQL, for the entry module to add when the subpackage is there."""

from __future__ import annotations

import importlib

#: Query name to the module that holds its ``query(spark, sf_dir)`` and, where SQL can say it, ``ORACLE_SQL``.
MODULES = {
    "op1_byte_bpe": "op1_byte_bpe",
    "op2_pii_surrogates": "op2_pii_surrogates",
    "op3_mixing": "op3_mixing",
    "op4_shingle_join": "op4_shingle_join",
    "op5_fingerprints": "op5_fingerprints",
    "op6_suffix_dedup": "op6_suffix_dedup",
    "op7_vptree_neighbours": "op7_vptree_neighbours",
    "op8_language_id": "op8_language_id",
    "op9_url_filters": "op9_url_filters",
    "op10_line_dedup": "op10_line_dedup",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__package__}.queries.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    made = {name: getattr(importlib.import_module(f"{__package__}.queries.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in made.items() if sql}
