"""Column expressions for text: templates, zero padding, file names, tokens."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical output.
# Prompt template exactly as the ini loader hands it to str.format: the outer
# double quotes and the two characters backslash and n are kept literally.
REFERENCE_PROMPT = ('"Answer the question using a single word or phrase. When the question '
                    'asks "How many...", respond with just a number (e.g., 3) and not the '
                    'word corresponding to the number.\\n{}"')
# Image file name: prefix, split, year, "_", id zero-padded to the width, suffix.
IMAGE_FILE_PREFIX = "COCO_"
IMAGE_YEAR = "2014"
IMAGE_ID_WIDTH = 12
IMAGE_FILE_SUFFIX = ".jpg"

# Our own choice (not a reference value): whitespace that separates tokens.
# Java and RE2 agree on this class; \s differs between them.
TOKEN_SPLIT = "[ \t\n\r]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_template(template: str) -> tuple[str, str]:
    """Split a one-field ``str.format`` template into (prefix, suffix).

    Escaped braces become literal braces; the field must be positional and
    plain (``{}`` or ``{0}``). Anything else is a driver-side error, raised
    before a job starts, instead of a failure inside a task.
    """
    parts = list(string.Formatter().parse(template))
    fields = [p for p in parts if p[1] is not None]
    if len(fields) != 1:
        raise ValueError(f"template needs exactly one field, found {len(fields)}")
    prefix, suffix, seen = [], [], False
    for literal, field, spec, conv in parts:
        (suffix if seen else prefix).append(literal)
        if field is not None:
            if field not in ("", "0") or spec or conv:
                raise ValueError(f"unsupported field {{{field}}} in template")
            seen = True
    return "".join(prefix), "".join(suffix)


def format_template(template: str, c) -> Column:
    """``template.format(value)`` as a JVM expression; braces in the value stay literal.

    A null value stays null (the Python original would render ``None``).
    """
    prefix, suffix = parse_template(template)
    return F.concat(F.lit(prefix), _col(c), F.lit(suffix))


def zero_pad(c, width: int = IMAGE_ID_WIDTH) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole (unlike lpad)."""
    s = _col(c).cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(s), F.lit(0))), s)


def image_file_name(image_id, split, year: str = IMAGE_YEAR) -> Column:
    """``COCO_{split}{year}_{12-digit id}.jpg``; ``split`` is a literal or a Column."""
    split_c = F.lit(split) if isinstance(split, str) else split
    return F.concat(F.lit(IMAGE_FILE_PREFIX), split_c, F.lit(f"{year}_"), zero_pad(image_id),
                    F.lit(IMAGE_FILE_SUFFIX))


def path_join(directory: str, name: Column) -> Column:
    """``os.path.join(directory, name)`` for a relative name and a literal directory."""
    if directory == "" or directory.endswith("/"):
        return F.concat(F.lit(directory), name)
    return F.concat(F.lit(directory + "/"), name)


def whitespace_tokens(c) -> Column:
    """Whitespace tokenizer: split on runs of space/tab/newline, drop empty strings.

    ``array_remove`` instead of a ``filter`` lambda keeps it in generated code.
    """
    return F.array_remove(F.split(_col(c), TOKEN_SPLIT), "")


def ngrams(tokens, n: int) -> Column:
    """Array of space-joined n-grams of a token array (empty when too short)."""
    t = _col(tokens)
    if n == 1:
        return t
    count = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
    grams = F.transform(F.array_repeat(F.lit(0), count),
                        lambda _, i: F.array_join(F.slice(t, i + 1, n), " "))
    return F.when(t.isNotNull(), grams)  # null tokens stay null
