"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontaminate import op9_decontamination
from .divergence import ORACLE_OP13, op13_source_divergence
from .huffman import op7_token_ids
from .lines import ORACLE_OP4, op4_line_dedup
from .middle import ORACLE_OP11, op11_fill_in_middle
from .packing import op10_packing
from .quality import op2_quality
from .scratch import modest_batches
from .sharding import ORACLE_OP6, op6_sharding
from .simhash import op8_simhash
from .substrings import op5_substring_dedup
from .token_counts import op12_token_counts
from .topk import ORACLE_OP1, op1_top_k
from .toxicity import op3_toxicity

OPERATORS = {
    "op1_top_k": op1_top_k,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_token_ids": op7_token_ids,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}


def _query(operator):
    def run(spark, sf_dir):
        modest_batches(spark)
        return operator(spark, sf_dir)

    return run


QUERIES = {name: _query(operator) for name, operator in OPERATORS.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": ORACLE_OP1,
    "op4_line_dedup": ORACLE_OP4,
    "op6_sharding": ORACLE_OP6,
    "op11_fill_in_middle": ORACLE_OP11,
    "op13_source_divergence": ORACLE_OP13,
}
