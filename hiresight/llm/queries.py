"""The registered queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from . import (covertree, lexical, lm, mixing, packing, pii, preference, quality, rans, sadedup, secrets, simhash,
               topk)

QUERIES = {f.__name__: f for f in (
    sadedup.op1_suffix_dedup,
    simhash.op2_simhash,
    topk.op3_topk,
    lm.op4_lm_score,
    secrets.op5_secret_scan,
    pii.op6_pii,
    rans.op7_rans_tokens,
    quality.op8_quality_rules,
    mixing.op9_mix_sources,
    packing.op10_best_fit_packing,
    preference.op11_quality_classifier,
    covertree.op12_hard_negatives,
    lexical.op13_lexical_search,
)}
SQL = {"op3_topk": topk.OP3_SQL, "op9_mix_sources": mixing.OP9_SQL, "op12_hard_negatives": covertree.OP12_SQL,
       "op13_lexical_search": lexical.OP13_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
