"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from tapeline.llm import (
    bpe,
    chat,
    classlm,
    covertree,
    infill,
    lines,
    minhash,
    mixing,
    perplexity,
    pii,
    search,
    urls,
    wrappers,
)

QUERIES = {
    "op1_chat_rotation": chat.query,
    "op2_kneser_ney_bands": perplexity.query,
    "op3_brown_classes": classlm.query,
    "op4_union_free_wrappers": wrappers.query,
    "op5_minhash_join": minhash.query,
    "op6_cover_tree_join": covertree.query,
    "op7_url_regression": urls.query,
    "op8_line_frequency": lines.query,
    "op9_golden_mix": mixing.query,
    "op10_segment_tree_bpe": bpe.query,
    "op11_norm_bucket_search": search.query,
    "op12_skip_chain_pii": pii.query,
    "op13_chunked_infill": infill.query,
}
ORACLE = {
    "op1_chat_rotation": chat.SQL,
    "op7_url_regression": urls.SQL,
    "op8_line_frequency": lines.SQL,
    "op9_golden_mix": mixing.SQL,
    "op11_norm_bucket_search": search.SQL,
    "op13_chunked_infill": infill.SQL,
}
