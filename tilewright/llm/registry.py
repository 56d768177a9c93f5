"""The queries of this package and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

from .bpe import op1_byte_bpe
from .chat import op8_reply_trees
from .embeddings import op3_pivot_neardup
from .language import op4_language_filters
from .packing import op5_bounded_packing
from .quality import OP7_SQL, op7_quality_cascade
from .scoring import op2_ppm_score
from .secrets import op10_trigram_secrets
from .simhash import op9_covering_simhash
from .toxicity import op6_subword_toxicity

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_ppm_score, op3_pivot_neardup, op4_language_filters, op5_bounded_packing, op6_subword_toxicity, op7_quality_cascade, op8_reply_trees, op9_covering_simhash, op10_trigram_secrets)}
ORACLE_SQL: dict[str, str] = {"op7_quality_cascade": OP7_SQL}
