"""Column-expression functions (JVM side, codegen friendly; no Python UDFs)."""

from stocklens.functions.coerce import key_int, key_text, num0, num_or_null, parse_mixed_date
from stocklens.functions.exact import exact_squares, exact_sum, limbs, recombine
from stocklens.functions.labels import days_since, efficiency_bucket, round_half_even, stagnant_bucket

__all__ = [
    "days_since", "efficiency_bucket", "exact_squares", "exact_sum", "key_int", "key_text", "limbs", "num0", "num_or_null",
    "parse_mixed_date", "recombine", "round_half_even", "stagnant_bucket",
]
