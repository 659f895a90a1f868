"""The subpackage's queries, and SQL where it can express them."""

from tidemark.llm.contexttree import op4_context_tree_scores
from tidemark.llm.graphann import op7_graph_neighbours
from tidemark.llm.jaccard import OP9_SQL, op9_jaccard_join
from tidemark.llm.media import op1_media_columns
from tidemark.llm.packing import op2_harmonic_packing
from tidemark.llm.pieces import op6_sentencepiece_scan
from tidemark.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from tidemark.llm.quality import op8_cotrained_quality
from tidemark.llm.repeats import OP5_SQL, op5_substring_dedup
from tidemark.llm.rollups import op3_token_rollups
from tidemark.llm.sharding import op10_feistel_sharding
from tidemark.llm.spelling import OP11_SQL, op11_spelling_variants
from tidemark.llm.toplists import OP12_SQL, op12_nra_top_k

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_token_rollups": op3_token_rollups,
    "op4_context_tree_scores": op4_context_tree_scores,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sentencepiece_scan": op6_sentencepiece_scan,
    "op7_graph_neighbours": op7_graph_neighbours,
    "op8_cotrained_quality": op8_cotrained_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_feistel_sharding": op10_feistel_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nra_top_k": op12_nra_top_k,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op5_substring_dedup": OP5_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_nra_top_k": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
