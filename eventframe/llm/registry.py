"""The corpus queries and, where SQL can express one, its DuckDB oracle."""

from eventframe.llm import (
    brown_lm,
    decontaminate,
    exact_dedup,
    jaccard_join,
    periodic_runs,
    pieces,
    secrets,
    simhash,
    suffix_array,
    suffix_tree,
    toxicity,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_simhash": simhash.op2_simhash,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_suffix_tree": suffix_tree.op4_suffix_tree,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_suffix_array": suffix_array.op7_suffix_array,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secrets": secrets.op9_secrets,
    "op10_brown_lm": brown_lm.op10_brown_lm,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_whitening": whitening.op12_whitening,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}

ORACLE = {
    "op4_suffix_tree": suffix_tree.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
}
