"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_near_dedup": "near_dedup",
    "op2_exact_dedup": "exact_dedup",
    "op3_sentencepiece": "pieces",
    "op4_tool_calls": "chat",
    "op5_secret_scan": "secrets",
    "op6_html_text": "html",
    "op7_media_columns": "media",
    "op8_kneser_ney": "ngram",
    "op9_quality": "quality",
    "op10_best_two_fit": "packing",
    "op11_token_cuts": "cuts",
    "op12_language": "language",
    "op13_hard_negatives": "negatives",
}


def _lazy(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _lazy(name, module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from .chat import OP4_SQL
    from .exact_dedup import OP2_SQL
    from .negatives import OP13_SQL

    return {"op2_exact_dedup": OP2_SQL, "op4_tool_calls": OP4_SQL, "op13_hard_negatives": OP13_SQL}
