"""Tokens: maximal runs of letters, digits and underscores of any script, or of other characters that are not white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond what \s has in Java and RE2.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
#: The pattern in Java's and RE2's syntax.
PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+"
#: The same in Python's.
TOKEN = re.compile(r"\w+|[^\w\s]+")


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("bigint")
