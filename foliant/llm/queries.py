"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, embed_dedup, filter_audit, language_id, lexical, line_dedup, mixing, packing, secret_scan, sharding, simhash, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_packing,
        language_id.op2_language_id,
        simhash.op3_simhash,
        secret_scan.op4_secret_scans,
        mixing.op5_mixing,
        ann.op6_ann_search,
        toxicity.op7_toxicity,
        embed_dedup.op8_embedding_dedup,
        line_dedup.op9_line_dedup,
        chat.op10_chat_formatting,
        lexical.op11_lexical_search,
        sharding.op12_sharding,
        filter_audit.op13_filter_audit,
    )
}
ORACLE_SQL = {
    "op4_secret_scans": secret_scan.ORACLE_SQL,
    "op10_chat_formatting": chat.ORACLE_SQL,
    "op11_lexical_search": lexical.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
