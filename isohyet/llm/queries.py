"""The numbered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_backoff": "op1_backoff",
    "op2_jaccard": "op2_jaccard",
    "op3_warc": "op3_warc",
    "op4_chat": "op4_chat",
    "op5_decontamination": "op5_decontamination",
    "op6_packing": "op6_packing",
    "op7_codes": "op7_codes",
    "op8_quality": "op8_quality",
    "op9_bayes": "op9_bayes",
    "op10_ring": "op10_ring",
    "op11_language": "op11_language",
    "op12_whitening": "op12_whitening",
    "op13_collocations": "op13_collocations",
}


def queries() -> dict:
    import corpus_pipeline

    numbered = {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _MODULES.items()}
    return numbered | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from . import op1_backoff, op4_chat, op13_collocations

    return {"op1_backoff": op1_backoff.ORACLE, "op4_chat": op4_chat.ORACLE, "op13_collocations": op13_collocations.ORACLE}
