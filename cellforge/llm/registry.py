"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from . import fingerprints, mixing, packing, partenum, quality_fm, rules, substring_dedup, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_quality_classifier": quality_fm.query,
        "op3_quality_rules": rules.query,
        "op4_warc_index": warc.query,
        "op5_minhash_fingerprints": fingerprints.query,
        "op6_kneser_ney_toxicity": toxicity.query,
        "op7_curriculum_mix": mixing.query,
        "op8_suffix_array_dedup": suffix_dedup.query,
        "op9_partenum_join": partenum.query,
        "op10_substring_dedup": substring_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": rules.oracle_sql(),
        "op4_warc_index": warc.ORACLE_SQL,
        "op7_curriculum_mix": mixing.ORACLE_SQL,
    }
