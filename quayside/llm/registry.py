"""Queries of the training-data operators, and their oracles where SQL can express them."""

from . import chat, trie
from .alignment import op13_cross_tokenizer_alignment
from .bpe import op3_bpe_round_trip
from .chat import op10_perspective_rotation
from .decontam import op6_benchmark_decontamination
from .language import op7_language_id
from .licenses import op1_license_scan
from .lines import op9_fuzzy_line_dedup
from .quality import op8_quality_rules
from .secrets import op5_secret_ownership
from .sharding import op4_virtual_slot_shards
from .simhash import op2_simhash_near_dedup
from .trie import op11_conversation_trie
from .vectors import op12_embedding_near_dedup

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_virtual_slot_shards": op4_virtual_slot_shards,
    "op5_secret_ownership": op5_secret_ownership,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
    "op10_perspective_rotation": op10_perspective_rotation,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {"op10_perspective_rotation": chat.ORACLE_SQL, "op11_conversation_trie": trie.ORACLE_SQL}
