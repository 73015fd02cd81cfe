"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import automaton, chat, exact_dedup, language, minhash, negatives, packing, pieces, pii, prefix_trie, sharding, url_rules, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language.op1_language_id,
    "op2_winnowing": winnow.op2_winnowing,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_packing": packing.op4_packing,
    "op5_minhash_dedup": minhash.op5_minhash_dedup,
    "op6_pii": pii.op6_pii,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_bpe_automaton": automaton.op11_bpe_automaton,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op5_minhash_dedup": minhash.OP5_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
