"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from strata.llm import ann, bpe, chat, langid, licences, neardup, pack, pii, quality, ranked, secrets, shard, spelling

QUERIES = {
    "op1_pii": pii.query,
    "op2_nearest_vectors": ann.query,
    "op3_near_duplicates": neardup.query,
    "op4_chat_format": chat.query,
    "op4_reply_trees": chat.tree_query,
    "op5_language_id": langid.query,
    "op5_language_id_pages": langid.page_query,
    "op6_best_fit_packing": pack.query,
    "op7_quality_rules": quality.query,
    "op8_secrets": secrets.query,
    "op9_sharding": shard.query,
    "op10_bpe": bpe.query,
    "op11_spelling_variants": spelling.query,
    "op12_licence_scan": licences.query,
    "op13_ranked_search": ranked.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_nearest_vectors": ann.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op4_chat_format": chat.SQL,
    "op4_reply_trees": chat.TREE_SQL,
    "op7_quality_rules": quality.SQL,
    "op13_ranked_search": ranked.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
