"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_decontaminate as op1
from . import op6_exact_topk as op6
from . import op8_source_mix as op8
from .op2_toxicity import op2_toxicity
from .op3_ngram_lm import op3_ngram_lm
from .op4_main_text import op4_main_text
from .op5_token_files import op5_token_files
from .op7_token_counts import op7_token_counts
from .op9_near_dedup import op9_near_dedup
from .op10_language_id import op10_language_id

QUERIES = {
    "op1_decontaminate": op1.op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_main_text": op4_main_text,
    "op5_token_files": op5_token_files,
    "op6_exact_topk": op6.op6_exact_topk,
    "op7_token_counts": op7_token_counts,
    "op8_source_mix": op8.op8_source_mix,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
}

SQL: dict[str, str] = {"op1_decontaminate": op1.SQL, "op6_exact_topk": op6.SQL, "op8_source_mix": op8.SQL}
