"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import decontaminate, exact_dedup, fill_middle, license_scan, line_dedup, merkle, mixing, quality_rules, secrets, simhash, suffix_dedup, suffix_tree_lm, toxicity


def queries():
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_quality_rules": quality_rules.query,
        "op3_repeated_bytes": suffix_dedup.query,
        "op4_suffix_tree_lm": suffix_tree_lm.query,
        "op5_decontaminate": decontaminate.query,
        "op6_simhash": simhash.query,
        "op7_license_scan": license_scan.query,
        "op8_source_mix": mixing.query,
        "op9_secret_scan": secrets.query,
        "op10_toxicity": toxicity.query,
        "op11_exact_dedup": exact_dedup.query,
        "op12_fill_middle": fill_middle.query,
        "op13_merkle_manifest": merkle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mix": mixing.ORACLE_SQL, "op11_exact_dedup": exact_dedup.ORACLE_SQL, "op12_fill_middle": fill_middle.ORACLE_SQL}
