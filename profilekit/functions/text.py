"""Name normalisation for matching."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Fixed value: generational suffixes that names are matched without.
GENERATIONS = ("jr", "sr", "ii", "iii", "iv")

_BLANK = r"[\s\p{Z}]"
#: What ``_BLANK`` holds of ASCII.
_ASCII_BLANK = " \t\n\x0b\f\r"


@arrow_udf(StringType())
def _decompose(text: pa.Array) -> pa.Array:
    # Spark has no Unicode decomposition; everything after it is built-in.
    return pc.utf8_normalize(text, form="NFD")


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(_decompose(text), r"\p{Mn}+", "")


def _plain_or_decomposed(drop: str):
    blanks = f"[{_ASCII_BLANK}]"

    @arrow_udf(StringType())
    def run(text: pa.Array) -> pa.Array:
        """ASCII texts normalised, the others decomposed."""
        plain = pc.string_is_ascii(text)
        low = pc.ascii_trim(pc.ascii_lower(text.filter(plain)), characters=_ASCII_BLANK)
        low = pc.replace_substring_regex(low, rf"{blanks}+({'|'.join(GENERATIONS)})\.?$", "")
        for char in drop:
            low = pc.replace_substring(low, char, "")
        # Few texts have other blanks than single spaces.
        spaced = pc.match_substring_regex(low, f"{blanks[:1]}{blanks[2:]}|  ")
        low = pc.replace_with_mask(low, spaced, pc.replace_substring_regex(low.filter(spaced), f"{blanks}+", " "))
        if len(low) == len(text):
            return low
        other = pc.invert(plain)
        return pc.replace_with_mask(pc.replace_with_mask(text, plain, low), other, pc.utf8_normalize(text.filter(other), form="NFD"))

    return run


def normalise_name(name: Column, drop: str = ".'") -> Column:
    """Lower case, no accents, no generational suffix, none of the ``drop`` characters, single spaces.

    Names of ASCII only, which have no accents, are done in one go beside the decomposition of the others.
    """
    first = _plain_or_decomposed(drop)(name)
    plain = F.lower(F.regexp_replace(first, r"\p{Mn}+", ""))
    plain = F.regexp_replace(plain, rf"^{_BLANK}+|{_BLANK}+$", "")
    plain = F.regexp_replace(plain, rf"{_BLANK}+({'|'.join(GENERATIONS)})\.?$", "")
    plain = F.translate(plain, drop, "")
    return F.when(F.length(name) == F.octet_length(name), first).otherwise(F.regexp_replace(plain, rf"{_BLANK}+", " "))
