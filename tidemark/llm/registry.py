"""The registered queries of the corpus operators."""

from __future__ import annotations

from tidemark.llm import ann, decontam, jaccard, langid, mixing, phrases, secrets, tokencount, urlrules, warc

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_secrets": secrets.query,
    "op3_decontaminate": decontam.query,
    "op4_token_counts": tokencount.query,
    "op5_jaccard_join": jaccard.query,
    "op6_language_id": langid.query,
    "op7_nearest": ann.query,
    "op8_warc": warc.query,
    "op9_substring_dedup": phrases.query,
    "op10_url_filter": urlrules.query,
    # those columns of three of them that SQL can express
    "mix_targets": mixing.targets_query,
    "secret_base_counts": secrets.base_query,
    "url_rule_parts": urlrules.parts_query,
}
ORACLE = {
    "op3_decontaminate": decontam.ORACLE_SQL,
    "op5_jaccard_join": jaccard.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_substring_dedup": phrases.ORACLE_SQL,
    "mix_targets": mixing.TARGETS_SQL,
    "secret_base_counts": secrets.BASE_SQL,
    "url_rule_parts": urlrules.PARTS_SQL,
}
