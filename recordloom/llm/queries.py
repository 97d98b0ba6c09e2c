"""The registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import mixing, nearest, packing, quality_rules, secret_scans, sharding, simhash, suffix_dedup, token_counts, token_output

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_secret_scans": secret_scans.op2_secret_scans,
    "op3_simhash": simhash.op3_simhash,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_nearest": nearest.op5_nearest,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_files": token_output.op9_token_files,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL = {"op2_secret_scans": secret_scans.OP2_SQL, "op5_nearest": nearest.OP5_SQL, "op10_quality_rules": quality_rules.OP10_SQL}
