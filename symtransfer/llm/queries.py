"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, license_scan, quality, substring_dedup, suffix_dedup, url_filter
from .bpe import op3_tree_bpe
from .exact_dedup import op4_patricia_exact_dedup
from .license_scan import op7_license_sentence_rules
from .packing import op2_sum_of_squares_packing
from .pii import op8_pii_surrogates
from .quality import op1_suffix_array_quality
from .simhash import op9_simhash_popcount_grid
from .substring_dedup import op10_suffix_automaton_dedup
from .suffix_dedup import op6_suffix_array_dedup
from .url_filter import op5_temporal_url_lists

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_quality, op2_sum_of_squares_packing, op3_tree_bpe, op4_patricia_exact_dedup, op5_temporal_url_lists,
        op6_suffix_array_dedup, op7_license_sentence_rules, op8_pii_surrogates, op9_simhash_popcount_grid, op10_suffix_automaton_dedup,
    )
}
SQL = {
    "op1_suffix_array_quality": quality.SQL,
    "op4_patricia_exact_dedup": exact_dedup.SQL,
    "op5_temporal_url_lists": url_filter.SQL,
    "op6_suffix_array_dedup": suffix_dedup.SQL,
    "op7_license_sentence_rules": license_scan.SQL,
    "op10_suffix_automaton_dedup": substring_dedup.SQL,
}
