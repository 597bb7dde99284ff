"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from floatline.llm.archive import OP8_SQL, op8_zip_warc
from floatline.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from floatline.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from floatline.llm.jaccard_join import op10_jaccard_join
from floatline.llm.language_id import op4_language_id
from floatline.llm.maxent_scoring import op12_maxent_scoring
from floatline.llm.mixing import op1_mix_sources
from floatline.llm.nearest import op7_hilbert_neighbours
from floatline.llm.packing import op6_best_fit_packing
from floatline.llm.passages import op9_fuzzy_passages
from floatline.llm.suffix_dedup import op3_suffix_dedup
from floatline.llm.token_alignment import op13_token_alignment
from floatline.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op8_zip_warc": op8_zip_warc,
    "op9_fuzzy_passages": op9_fuzzy_passages,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_maxent_scoring": op12_maxent_scoring,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {"op5_exact_dedup": OP5_SQL, "op8_zip_warc": OP8_SQL, "op11_conversation_repair": OP11_SQL}
