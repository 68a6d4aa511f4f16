"""Registry of the training-data queries and of their SQL, for __spark_entry__.py."""

from __future__ import annotations

from cadenza.llm.alignment import op11_token_alignment
from cadenza.llm.embeddings import op13_embedding_near_dedup
from cadenza.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from cadenza.llm.fill_middle import OP12_SQL, op12_fill_middle
from cadenza.llm.licenses import op6_license_paragraphs
from cadenza.llm.mixing import op10_temperature_mixing
from cadenza.llm.mpeg import op4_mpeg_audio
from cadenza.llm.packing import op3_best_fit_packing
from cadenza.llm.perspectives import OP5_SQL, op5_perspective_rotation
from cadenza.llm.secrets import op1_secret_ownership
from cadenza.llm.simhash import op2_simhash_near_dedup
from cadenza.llm.substrings import op7_suffix_array_dedup
from cadenza.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_license_paragraphs": op6_license_paragraphs,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_temperature_mixing": op10_temperature_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_middle": op12_fill_middle,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
ORACLE_SQL = {"op5_perspective_rotation": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op12_fill_middle": OP12_SQL}
