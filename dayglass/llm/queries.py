"""The registered queries of this subpackage and their DuckDB twins, where SQL can express them."""

from . import (
    bpe, chat_format, fingerprints, hard_negatives, jaccard_join, lm_scores, mixing, pieces, quality_rules, secret_scans, toxicity, url_filters, whitening,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_secret_scans": secret_scans.query,
    "op3_sentencepiece": pieces.query,
    "op4_mixing": mixing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_url_filters": url_filters.query,
    "op7_lm_scoring": lm_scores.query,
    "op8_chat_formatting": chat_format.query,
    "op9_ngram_jaccard": jaccard_join.query,
    "op10_fingerprints": fingerprints.query,
    "op11_bpe": bpe.query,
    "op12_whitening": whitening.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_url_filters": url_filters.ORACLE,
    "op8_chat_formatting": chat_format.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
