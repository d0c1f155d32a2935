"""The registered queries of this subpackage, and DuckDB SQL where SQL can give the same rows."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm.byte_bpe import op6_byte_bpe
from tessera.llm.divergence import op1_divergence_rules
from tessera.llm.hard_negatives import op11_sorted_hard_negatives
from tessera.llm.lm_scoring import op4_gru_scores
from tessera.llm.minmax import op9_minmax_dedup
from tessera.llm.mixing import op12_water_filled_mix
from tessera.llm.nbsvm import op5_quality_classifier
from tessera.llm.oracle import ORACLE_SQL as OPERATOR_SQL
from tessera.llm.packing import op10_genetic_packing
from tessera.llm.personal import op8_personal_data
from tessera.llm.ranked_search import op13_range_maximum_search
from tessera.llm.substring_dedup import op2_fm_dedup
from tessera.llm.tokens import op3_token_table
from tessera.llm.transport_stream import op7_transport_stream

QUERIES = {
    "op1_divergence_rules": op1_divergence_rules,
    "op2_fm_dedup": op2_fm_dedup,
    "op3_token_table": op3_token_table,
    "op4_gru_scores": op4_gru_scores,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_transport_stream": op7_transport_stream,
    "op8_personal_data": op8_personal_data,
    "op9_minmax_dedup": op9_minmax_dedup,
    "op10_genetic_packing": op10_genetic_packing,
    "op11_sorted_hard_negatives": op11_sorted_hard_negatives,
    "op12_water_filled_mix": op12_water_filled_mix,
    "op13_range_maximum_search": op13_range_maximum_search,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = OPERATOR_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
