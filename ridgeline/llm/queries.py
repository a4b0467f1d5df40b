"""The subpackage's queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from ridgeline.llm.chat_format import OP6_SQL, op6_chat_format
from ridgeline.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from ridgeline.llm.mixing import OP10_SQL, op10_source_mixing
from ridgeline.llm.packing import op8_packing
from ridgeline.llm.quality import OP9_SQL, op9_quality_rules
from ridgeline.llm.secret_scan import op4_secret_scan
from ridgeline.llm.simhash import op7_simhash
from ridgeline.llm.token_output import op1_token_output
from ridgeline.llm.toxicity import op5_toxicity
from ridgeline.llm.url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op6_chat_format": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_source_mixing": OP10_SQL,
}
