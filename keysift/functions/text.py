"""Key parsing and character n-grams as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text forms that count as a number (no padding, suffixes, NaN spellings excepted).
NUMBER_PATTERN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"


def segment(key: Column, index: int) -> Column:
    return F.get(F.split(key, ":"), F.lit(index))


def parse_key(key: Column) -> Column:
    """``hash:decimal:hex`` as the two doubles ``[decimal, hex]``; NULL where a part is not a number."""
    return F.array(
        segment(key, 1).try_cast("double"), F.conv(segment(key, 2), 16, 10).try_cast("double")
    )


def strip_prefix(key: Column) -> Column:
    """Everything after the first colon; empty without a colon."""
    parts = F.split(key, ":")
    return F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ":")


def is_number(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(NUMBER_PATTERN)


def guarded_prediction(key: Column, prediction: Column) -> Column:
    """0 for an empty or non-numeric key and where there is no model; else the model's answer."""
    return F.when((key == "") | ~is_number(key), 0).otherwise(F.coalesce(prediction, F.lit(0)))


def zero_padded(text: Column, width: Column) -> Column:
    """``text`` filled up on the right with zeros; longer text stays whole."""
    return F.concat(text, F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0)).cast("int")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a lambda would evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slide(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def _grams(padded: Column, size: int, fallback: bool) -> Column:
    short = F.array(padded) if fallback else F.array().cast("array<string>")
    return F.when(F.length(padded) < size, short).otherwise(_slide(padded, size))


def char_ngrams(text: Column, size: int, width: Column) -> Column:
    """Sliding n-grams of the padded text; a padded text shorter than ``size`` is its own gram."""
    return let(zero_padded(text, width), lambda p: _grams(p, size, True))


def char_ngrams_dim(text: Column, size: int, dimension: Column) -> Column:
    """n-grams for a required number of columns: padded to ``dimension + size - 1``, without fallback."""
    return let(zero_padded(text, dimension + size - 1), lambda p: _grams(p, size, False))


def char_ngram_range(text: Column, smallest: int, largest: int, width: Column) -> Column:
    """n-grams of all sizes from ``smallest`` to ``min(largest, width)``, in order of size."""

    def grams(padded: Column) -> Column:
        none = F.array().cast("array<string>")
        sizes = range(smallest, largest + 1)
        return F.concat(*[F.when(F.lit(size) <= width, _grams(padded, size, True)).otherwise(none) for size in sizes])

    return let(zero_padded(text, width), grams)


def gram_sentence(grams: Column) -> Column:
    return F.array_join(grams, " ")


def float_text(value: Column) -> Column:
    """A double as text with a fraction part (``12.0``), as number columns are rendered for n-grams."""
    integral = (value == F.floor(value)) & (F.abs(value) < 1e16)
    return F.when(integral, F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def numbers(grams: Column) -> Column:
    """Grams as doubles; NULL where a gram is not a number.

    The full pattern is only tried on rows that hold a letter or a blank, where the cast alone
    would accept spellings such as ``1d``.
    """

    def convert(all_grams: Column) -> Column:
        plain = F.transform(all_grams, lambda g: g.try_cast("double"))
        checked = F.transform(all_grams, lambda g: F.when(is_number(g), g.try_cast("double")))
        return F.when(F.array_join(all_grams, "").rlike(r"[^0-9.+\-]"), checked).otherwise(plain)

    return let(grams, convert)


def tokens(sentence: Column) -> Column:
    """Lower-case tokens: runs of two or more letters, digits or underscores of any script."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
