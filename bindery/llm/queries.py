"""The registered queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

from bindery.llm.ann import op5_nearest
from bindery.llm.divergence import OP12_SQL, op12_source_divergence
from bindery.llm.encoding import op7_bpe_round_trip
from bindery.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from bindery.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from bindery.llm.html_extract import op3_html_extract
from bindery.llm.idfile import op9_id_files
from bindery.llm.lm_score import op2_lm_score
from bindery.llm.packing import op8_packing
from bindery.llm.simhash import op10_simhash
from bindery.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from bindery.llm.token_counts import op11_token_counts
from bindery.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_score": op2_lm_score,
    "op3_html_extract": op3_html_extract,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_nearest": op5_nearest,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_packing": op8_packing,
    "op9_id_files": op9_id_files,
    "op10_simhash": op10_simhash,
    "op11_token_counts": op11_token_counts,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op4_exact_dedup": OP4_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
