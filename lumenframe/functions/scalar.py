"""Scalar expressions whose built-in namesakes differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (trim drops blanks only)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def divide(a: Column, b: Column) -> Column:
    """a / b in doubles: x / 0 is infinite with x's sign, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))


def parse_datetime(c: Column) -> Column:
    """YYYY-MM-DD, or that with HH:MM:SS after a T or a blank; null if neither."""
    text = F.regexp_replace(F.substring(c, 1, 19), "T", " ")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def normalize(c: Column) -> Column:
    """Lower-cased, only letters, digits and blanks left."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]", "")


def words(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Each n tokens in a row, joined by a blank: the array beside copies of itself that begin later."""
    out = tokens
    for k in range(1, n):
        later = F.slice(tokens, F.lit(1 + k), F.greatest(F.size(tokens) - k, F.lit(0)))
        out = F.zip_with(out, later, lambda a, b: F.concat(a, F.lit(" "), b))  # null where the copy has ended
    return F.filter(out, lambda x: x.isNotNull())


def char_ngrams(text: Column, n: int) -> Column:
    """Each n characters in a row; the text is split into characters once."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    out = letters
    for k in range(1, n):
        later = F.slice(letters, F.lit(1 + k), F.greatest(F.size(letters) - k, F.lit(0)))
        out = F.zip_with(out, later, lambda a, b: F.concat(a, b))
    return F.filter(out, lambda x: x.isNotNull())


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists, as sets; 1 for two empty ones."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity; 0 where either vector is null in length."""
    below = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(below == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(below, F.lit(0.0)))
