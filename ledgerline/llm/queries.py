"""Queries over the text operators and, where SQL can express them, their DuckDB equivalents."""

from ledgerline.llm.chat_format import OP7_SQL, op7_chat_format
from ledgerline.llm.decontamination import OP3_SQL, op3_decontamination
from ledgerline.llm.divergence import OP12_SQL, op12_divergence
from ledgerline.llm.language_id import op6_language_id
from ledgerline.llm.license_scan import op2_license_scan
from ledgerline.llm.packing import op8_packing
from ledgerline.llm.pii import op1_pii
from ledgerline.llm.quality_rules import op5_quality_rules
from ledgerline.llm.resampling import OP11_SQL, op11_resampling
from ledgerline.llm.simhash import op4_simhash_near_dedup
from ledgerline.llm.suffix_dedup import op10_suffix_dedup
from ledgerline.llm.token_counts import op9_token_counts
from ledgerline.llm.warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_chat_format": op7_chat_format,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_resampling": op11_resampling,
    "op12_divergence": op12_divergence,
    "op13_warc": op13_warc,
}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op7_chat_format": OP7_SQL, "op11_resampling": OP11_SQL, "op12_divergence": OP12_SQL, "op13_warc": OP13_SQL}
