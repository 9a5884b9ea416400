"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from foliant.llm.fill_middle import OP13_SQL, op13_fill_in_middle
from foliant.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from foliant.llm.line_dedup import OP5_SQL, op5_line_dedup
from foliant.llm.mixing import op6_mixing
from foliant.llm.near_dup import op10_near_dup
from foliant.llm.permutation_index import op1_permutation_index
from foliant.llm.private_data import op8_private_data
from foliant.llm.quality_rules import op7_quality_rules
from foliant.llm.quality_trees import op4_quality_trees
from foliant.llm.sentence_pieces import op9_sentence_pieces
from foliant.llm.small_world import OP11_SQL, op11_small_world
from foliant.llm.token_counts import op3_token_counts
from foliant.llm.toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_permutation_index, op2_toxicity, op3_token_counts, op4_quality_trees, op5_line_dedup, op6_mixing, op7_quality_rules, op8_private_data, op9_sentence_pieces, op10_near_dup,
        op11_small_world, op12_hard_negatives, op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op11_small_world": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
