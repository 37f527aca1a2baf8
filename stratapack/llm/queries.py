"""Driver queries of this subpackage: opN_<name> for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .decontamination import OP10_SQL, op10_benchmark_decontamination
from .html_extraction import OP3_SQL, op3_html_extraction
from .language_id import op6_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .near_dedup import OP4_SQL, op4_minhash_near_dedup
from .quality_rules import OP8_SQL, op8_quality_rules
from .sentencepiece_nbest import op1_sentencepiece
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op2_substring_dedup": op2_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op1_sentencepiece": op1_sentencepiece,
    "op3_html_extraction": op3_html_extraction,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_html_extraction": OP3_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
}
