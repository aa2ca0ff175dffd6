"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import op01_quality_rules, op02_decontamination, op04_minhash_dedup, op08_substring_dedup, op10_license_scan
from .op03_katz_backoff import op3_katz_backoff
from .op05_warc import op5_warc
from .op06_best_fit_packing import op6_best_fit_packing
from .op07_quality_classifier import op7_quality_classifier
from .op09_toxicity import op9_toxicity

QUERIES = {
    "op1_quality_rules": op01_quality_rules.op1_quality_rules,
    "op2_decontamination": op02_decontamination.op2_decontamination,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_minhash_dedup": op04_minhash_dedup.op4_minhash_dedup,
    "op5_warc": op5_warc,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_substring_dedup": op08_substring_dedup.op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan.op10_license_scan,
}
ORACLE_SQL = {
    "op1_quality_rules": op01_quality_rules.ORACLE,
    "op2_decontamination": op02_decontamination.ORACLE,
    "op4_minhash_dedup": op04_minhash_dedup.ORACLE,
    "op8_substring_dedup": op08_substring_dedup.ORACLE,
    "op10_license_scan": op10_license_scan.ORACLE,
}
