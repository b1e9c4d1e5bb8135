"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tastemap.llm.chat_format import OP10_SQL, op10_chat_format
from tastemap.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from tastemap.llm.decontaminate import OP1_SQL, op1_decontaminate
from tastemap.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from tastemap.llm.language_id import op2_language_id
from tastemap.llm.line_dedup import op7_line_dedup
from tastemap.llm.near_dedup import op9_near_dedup
from tastemap.llm.packing import op8_best_fit_packing
from tastemap.llm.pii import op5_personal_data
from tastemap.llm.quality import op11_quality_fm
from tastemap.llm.secrets_scan import op6_secret_scan
from tastemap.llm.spelling_variants import OP12_SQL, op12_spelling_variants
from tastemap.llm.token_rollup import op4_token_rollup

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_rollup": op4_token_rollup,
    "op5_personal_data": op5_personal_data,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_quality_fm": op11_quality_fm,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op1_decontaminate": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op10_chat_format": OP10_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
