"""Queries over the shared tables, one for each operator of this subpackage."""

from __future__ import annotations

from .gam import op7_quality_classifier
from .mixing import op9_mixing
from .nn_descent import op8_nearest
from .packing import op4_packing
from .quality_rules import SQL as QUALITY_RULES_SQL
from .quality_rules import op10_quality_rules
from .recompress import op5_substring_dedup
from .simhash import op1_simhash
from .stupid_backoff import op2_lm_scores
from .token_files import op3_token_files
from .toxicity import op6_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm_scores": op2_lm_scores,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {"op10_quality_rules": QUALITY_RULES_SQL}
