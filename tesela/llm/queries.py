"""The registry of this subpackage: opN_<name> and, for those that SQL can express, the SQL."""

from tesela.llm import byte_bpe, exact_dedup, jaccard, line_dedup, media, packing, pii, quality, substring_dedup, suffix_dedup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_line_dedup": line_dedup.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_ngram_jaccard": jaccard.query,
    "op5_pii": pii.query,
    "op6_packing": packing.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_media": media.query,
    "op10_quality": quality.query,
}
SQL = {"op7_exact_dedup": exact_dedup.SQL}
