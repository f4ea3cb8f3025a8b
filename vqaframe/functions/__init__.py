from vqaframe.functions.arrays import argmax, index_range, log_sum_exp, nll, safe_slice
from vqaframe.functions.parse import python_float
from vqaframe.functions.strings import (
    REFERENCE_PROMPT,
    format_template,
    image_file_name,
    ngrams,
    parse_template,
    path_join,
    whitespace_tokens,
    zero_pad,
)

__all__ = [
    "argmax", "index_range", "log_sum_exp", "nll", "safe_slice", "python_float",
    "REFERENCE_PROMPT", "format_template", "image_file_name", "ngrams", "parse_template",
    "path_join", "whitespace_tokens", "zero_pad",
]
