"""String expressions with Python's rules for whitespace, title case and missing tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewise.constants import MISSING_TOKENS

# Whitespace as Python's str.strip sees it: the Unicode property plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
_EDGE_SPACE = rf"(?U)^{_SPACE}+|{_SPACE}+$"
# Letters that have a case. A run of them is one word for str.title.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_CASE_RUNS = rf"([{_CASED}]+|[^{_CASED}]+)"


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` removes spaces only)."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def title_case(col: Column) -> Column:
    """Upper-case the first letter of every run of cased letters: ``1-URGENT`` -> ``1-Urgent``."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(_CASE_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def fold_missing(col: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """NULL for a missing token, else the text unchanged."""
    return F.when(~col.isin(*tokens), col)
