"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.decontam import OP10_SQL, op10_decontamination
from tessera.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from tessera.llm.packing import op2_packing
from tessera.llm.quality import op9_quality_classifier
from tessera.llm.secrets import op3_secret_scan
from tessera.llm.simhash import op1_simhash
from tessera.llm.suffix_tree import op4_lm_scoring
from tessera.llm.token_counts import op8_token_counts
from tessera.llm.token_files import op6_token_files
from tessera.llm.warc import OP5_SQL, op5_warc


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_packing": op2_packing,
        "op3_secret_scan": op3_secret_scan,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_warc": op5_warc,
        "op6_token_files": op6_token_files,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op10_decontamination": OP10_SQL}
