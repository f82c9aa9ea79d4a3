"""Scalar Column builders (JVM-side expressions, no Python UDFs)."""

from .text import (  # noqa: F401
    blank_to_null, digits_only, fallback_name, join_label,
    norm_column_name, norm_text, pad_code, upper_unaccent,
)
from .numeric import (  # noqa: F401
    decimal_comma, nonneg_int, range_or_null, ratio_round,
    try_bigint,
)
from .rules import (  # noqa: F401
    append_flags, array_has, bed_range, code_label,
    competence_valid, dedupe_key, geo_reliable, mmyyyy_to_yyyymm, parse_bool,
    prefix_any, slash_competence,
)
