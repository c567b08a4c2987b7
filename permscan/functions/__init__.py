from .scalars import (
    chi2_tail,
    decoded,
    effect_z,
    flags,
    is_malformed,
    job_name,
    number,
    perm_id,
    perm_name,
    rows_as_json,
    source_name,
    three_digits,
    trait_number,
    variant_stem,
)

__all__ = [
    "chi2_tail",
    "decoded",
    "effect_z",
    "flags",
    "is_malformed",
    "job_name",
    "number",
    "perm_id",
    "perm_name",
    "rows_as_json",
    "source_name",
    "three_digits",
    "trait_number",
    "variant_stem",
]
