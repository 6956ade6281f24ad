"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, codes, decontaminate, license_scan, line_dedup, minmax, packing, token_store, topk, toxicity, trie, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_minmax": minmax.op2_minmax,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_store": token_store.op5_token_store,
    "op6_warc": warc.op6_warc,
    "op7_chat": chat.op7_chat,
    "op8_topk": topk.op8_topk,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_packing": packing.op13_packing,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_topk": topk.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "op11_vector_codes": codes.oracle(),
    "op12_prefix_trie": trie.ORACLE,
}
