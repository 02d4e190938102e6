"""Names of songs and artists as keys. Only Unicode normal forms leave the JVM, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_CUT = "\u0001"  # between the names of a list; no name holds it


def _folded(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(pc.utf8_lower(pc.utf8_normalize(text, "NFKC")), "NFD")


def folded(text: Column) -> Column:
    """Compatibility forms as one, lower case, accents as characters of their own."""
    return F.arrow_udf(_folded, StringType())(text)


def composed(text: Column, form: str = "NFC") -> Column:
    """A Unicode normal form, marks joined with their letters."""
    one = lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x)
    return F.arrow_udf(lambda t: pa.array(map(one, t.to_pylist()), pa.string()), StringType())(text)


def _words(folded_text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(folded_text, r"\p{M}+", ""), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"['’‘`´.]", ""), r"[^\p{L}\p{N}]+", " "))


def _key(words: Column) -> Column:
    return F.replace(words, F.lit(" "), F.lit(""))


def name_words(text: Column) -> Column:
    """Lower case without accents, & as and, nothing but letters, digits and single blanks."""
    return _words(folded(text))


def name_key(text: Column) -> Column:
    """The words without blanks."""
    return _key(name_words(text))


def artist_key(text: Column) -> Column:
    """The key without a leading "the"."""
    return _key(F.regexp_replace(name_words(text), "^the ", ""))


def _keys(names: Column, change: Callable[[Column], Column]) -> Column:
    parts = F.split(folded(F.array_join(names, _CUT)), _CUT)
    return F.filter(F.transform(parts, lambda n: _key(change(_words(n)))), lambda n: n != "")


def name_keys(names: Column) -> Column:
    """The key of each name of a list, empty ones left out; one pass for the whole list."""
    return _keys(names, lambda w: w)


def artist_keys(names: Column) -> Column:
    """The same without a leading "the"."""
    return _keys(names, lambda w: F.regexp_replace(w, "^the ", ""))


def has_words(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def split_names(credit: Column) -> Column:
    """The names of a credit, which are set apart by commas, ampersands, "and" or a lone x; parts without a letter or digit are none."""
    parts = F.split(credit, r"(?U)\s*(?:,|&|\band\b|\s[x×]\s)\s*")
    return F.filter(F.transform(parts, lambda n: F.trim(n)), has_words)


# Words and signs between the names of a credit.
CREDIT_WORDS = ("feat", "feat.", "ft", "ft.", "featuring", "with", "vs", "vs.")
CREDIT_SIGNS = (",", "&", "+")


def credit_names(credit: Column) -> Column:
    """Every name of a credit, guests and rivals too; of letters between names only a small x (or the sign) parts them, so "Lil Nas X" is one."""
    words = "|".join(w.replace(".", r"\.") for w in sorted(CREDIT_WORDS, key=len, reverse=True))
    signs = "".join(CREDIT_SIGNS)
    parts = F.split(credit, rf"(?iU)\s+(?:{words})\s+|\s*(?:[{signs}]|\band\b)\s*")
    each = F.flatten(F.transform(parts, lambda p: F.split(p, r"(?U)\s+[x×]\s+")))
    return F.filter(F.transform(each, lambda n: F.trim(n)), lambda n: n != "")
