"""Names of the corpus queries and, where SQL can express them, their expected results."""

from __future__ import annotations

from tracewell.llm import bpe, chat, decontaminate, merkle, mixing, quality, secrets, simhash, substrings, tokens, topk, toxicity, whitening

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_scores": quality.op3_quality_scores,
    "op4_secret_spans": secrets.op4_secret_spans,
    "op5_repeated_bytes": substrings.op5_repeated_bytes,
    "op6_chat_format": chat.op6_chat_format,
    "op7_simhash_groups": simhash.op7_simhash_groups,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_benchmark_hits": decontaminate.op9_benchmark_hits,
    "op10_exact_neighbours": topk.op10_exact_neighbours,
    "op11_whitened_embeddings": whitening.op11_whitened_embeddings,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_byte_bpe": bpe.op13_byte_bpe,
}

SQL = {
    "op6_chat_format": chat.OP6_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op9_benchmark_hits": decontaminate.OP9_SQL,
    "op10_exact_neighbours": topk.OP10_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
