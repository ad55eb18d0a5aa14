"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module


def _lazy(module: str):
    def run(spark, sf_dir):
        return import_module(f"caseflow.llm.{module}").query(spark, sf_dir)

    return run


#: name of the query -> module whose ``query`` runs it
MODULES = {
    "op13_importance": "importance",
    "op12_fill_in_middle": "fill_in_middle",
    "op11_exact_dedup": "exact_dedup",
    "op10_html_extract": "html_extract",
    "op9_ngram_join": "ngram_join",
    "op7_suffix_dedup": "suffix_dedup",
    "op6_neighbours": "neighbours",
    "op5_secret_scan": "secret_scan",
    "op4_warc_archive": "warc_archive",
    "op3_packing": "packing",
    "op1_language_id": "language_id",
    "op2_bpe_automaton": "bpe_automaton",
    "op8_quality_rules": "quality_rules",
}
QUERIES = {name: _lazy(module) for name, module in MODULES.items()}


def _oracles() -> dict[str, str]:
    found = {name: getattr(import_module(f"caseflow.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}


ORACLES: dict[str, str] = _oracles()
