"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, line_dedup, manifest, mixing, pii, quality, simhash, suffixes, toxicity, trie, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_line_dedup": line_dedup.query,
    "op3_quality_rules": quality.query,
    "op4_pii": pii.query,
    "op5_toxicity": toxicity.query,
    "op6_warc": warc.query,
    "op7_mixing": mixing.query,
    "op8_decontamination": decontaminate.query,
    "op9_license_scan": licenses.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_conversation_trie": trie.query,
    "op12_merkle_manifest": manifest.query,
    "op13_suffix_dedup": suffixes.query,
}

SQL: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op3_quality_rules": quality.SQL,
    "op6_warc": warc.SQL,
    "op7_mixing": mixing.SQL,
    "op9_license_scan": licenses.SQL,
    "op11_conversation_trie": trie.SQL,
    "op12_merkle_manifest": manifest.SQL,
}
