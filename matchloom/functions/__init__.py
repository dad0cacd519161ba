"""Column functions: strings, dates, colours, distances and threshold predicates."""

from .distance import damerau_levenshtein_distance, jaro_similarity, jaro_winkler_similarity, levenshtein_distance, osa_distance
from .norm import COLLATION, fold_accents, norm, same
from .predicates import PREDICATES
from .strings import age, extract_param, extract_pattern, fingerprint, gradient_hex, hexcode_to_rgb, json_formatter, replace_all, split_rows, start_case, string_split_item, title_case

__all__ = [
    "COLLATION", "PREDICATES", "age", "damerau_levenshtein_distance", "extract_param", "extract_pattern", "fingerprint", "fold_accents", "gradient_hex", "hexcode_to_rgb",
    "jaro_similarity", "jaro_winkler_similarity", "json_formatter", "levenshtein_distance", "norm", "osa_distance", "replace_all", "same", "split_rows", "start_case", "string_split_item", "title_case",
]
