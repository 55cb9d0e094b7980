from rollscan.functions.text import (  # noqa: F401
    basename,
    guardian_pattern,
    has_inner_whitespace,
    name_pattern,
    normalize_bn,
    py_split,
    py_strip,
    token_set_key,
)
