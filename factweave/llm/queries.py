"""Queries of the training-data operators and, where SQL can express them, their oracle."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, exact_dedup, licenses, mixing, near_dedup, neighbours, quality, toxicity, warc

_MODULES = {
    "op1_warc": warc,
    "op2_mixing": mixing,
    "op3_quality": quality,
    "op4_chat": chat,
    "op5_exact_dedup": exact_dedup,
    "op6_near_dedup": near_dedup,
    "op7_bpe": bpe,
    "op8_licenses": licenses,
    "op9_toxicity": toxicity,
    "op10_neighbours": neighbours,
}


def queries():
    return {name: module.query for name, module in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)} | pipeline
