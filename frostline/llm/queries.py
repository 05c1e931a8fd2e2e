"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from frostline.llm import bpe, content_sort, langid, lattice_lm, line_dedup, minhash, packing, prefix_trie, quality, shards, spelling, syncmers, url_rules

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_minhash": minhash.op3_minhash,
    "op4_subword_lattice": lattice_lm.op4_subword_lattice,
    "op5_nearest_centroid": langid.op5_nearest_centroid,
    "op6_interleave": shards.op6_interleave,
    "op7_tree_concatenation": bpe.op7_tree_concatenation,
    "op8_pack": packing.op8_pack,
    "op9_association_rules": url_rules.op9_association_rules,
    "op10_content_sort": content_sort.op10_content_sort,
    "op11_spelling": spelling.op11_spelling,
    "op12_syncmers": syncmers.op12_syncmers,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_quality_rules": quality.OP2_SQL,
    "op6_interleave": shards.OP6_SQL,
    "op10_content_sort": content_sort.OP10_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
