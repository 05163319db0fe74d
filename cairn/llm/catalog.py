"""Registered queries of the corpus-preparation operators and their SQL."""

from __future__ import annotations

from cairn.llm import decontaminate, filter_audit, fingerprint, jaccard_join, lexical_search, line_dedup
from cairn.llm import minhash_dedup, packing, secret_scan, sharding, toxicity, training_order, warc

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_training_order": training_order.op8_training_order,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_minhash": minhash_dedup.op12_minhash,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_minhash": minhash_dedup.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
