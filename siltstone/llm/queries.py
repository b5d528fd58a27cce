"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from siltstone.llm.byte_bpe import op1_byte_bpe
from siltstone.llm.embedding_dedup import op6_embedding_dedup
from siltstone.llm.line_dedup import SQL as LINE_DEDUP_SQL
from siltstone.llm.line_dedup import op4_line_dedup
from siltstone.llm.near_dedup import op9_near_dedup
from siltstone.llm.packing import op3_packing
from siltstone.llm.pii import op5_pii
from siltstone.llm.secret_scan import op13_secret_scan
from siltstone.llm.sharding import op7_sharding
from siltstone.llm.spelling import op11_spelling_variants
from siltstone.llm.token_counts import op2_token_counts
from siltstone.llm.topk import op8_topk
from siltstone.llm.toxicity import op10_toxicity
from siltstone.llm.vector_codes import op12_vector_codes


def queries() -> dict:
    ops = (
        op1_byte_bpe,
        op2_token_counts,
        op3_packing,
        op4_line_dedup,
        op5_pii,
        op6_embedding_dedup,
        op7_sharding,
        op8_topk,
        op9_near_dedup,
        op10_toxicity,
        op11_spelling_variants,
        op12_vector_codes,
        op13_secret_scan,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator over its whole table; the others are tested against brute force."""
    return {"op4_line_dedup": LINE_DEDUP_SQL}
