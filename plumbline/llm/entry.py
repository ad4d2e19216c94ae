"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import decontaminate, exact_dedup, fim, html_extract, importance, langid, pieces, pii, quality, rans, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_language_id": langid.op4_language_id,
    "op5_token_files": rans.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_sharding": sharding.op8_sharding,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_html_extraction": html_extract.op10_html_extraction,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_quality_rules": quality.op13_quality_rules,
    "benchmark_passages": decontaminate.benchmark_passages,  # the members of the classes in op9's result
}
ORACLE_SQL = {
    "op3_pii": pii.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op8_sharding": sharding.ORACLE,
    "op11_importance_resampling": importance.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_quality_rules": quality.ORACLE,
}
