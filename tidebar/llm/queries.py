"""The registered queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, bytebpe, chat, licenses, lm, minhash, mixing, pii, search, simhash, toxicity, turns

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_minhash": minhash.query,
    "op3_toxicity": toxicity.query,
    "op4_licenses": licenses.query,
    "op5_pii": pii.query,
    "op6_chat": chat.query,
    "op7_lm": lm.query,
    "op8_simhash": simhash.query,
    "op9_mixing": mixing.query,
    "op10_ann": ann.query,
    "op11_turns": turns.query,
    "op12_search": search.query,
    "op13_byte_bpe": bytebpe.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op6_chat": chat.SQL,
    "op11_turns": turns.SQL,
    "op12_search": search.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
