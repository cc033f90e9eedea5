"""String, regex and number-in-text functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.arrays import once

# Words that never count as query terms.
STOPWORDS = (
    "a an the is are was were be been being do does did to of on in for by with and or as at "
    "from that this these those it its i you we they he she have has had can could should would "
    "will what which how when where why who please me my your"
).split()

WORD = r"[\p{L}\p{N}]+"

# How a letter is found in a short and in a long reply.
SHORT_LEAD = r"^\(?([A-L])\b"
LONE_LETTER = r"\b([A-L])\b"
STATED_LETTER = r"(?i)(?:answer|option)\W{0,12}(?:is\W{0,4})?\(?([A-L])\b"

# Marks around a receipt amount, and the number shapes that are read, each with the characters to
# translate so that a decimal point is all that is left (first shape that fits).
AMOUNT_CORE = r"(?i)^\s*(?:(?:rp\.?|idr|rm|@|x)\s*)?(.*?)(?:\s*(?:rp|sr|zr|z|s))?\s*$"
AMOUNT_SHAPES = (
    (r"^\d{1,3}([.,]\d{3})+$", ".,", ""),
    (r"^\d+$", "", ""),
    (r"^\d{1,3}(,\d{3})*\.\d{1,2}$", ",", ""),
    (r"^\d+,\d{1,2}$", ",", "."),
)

# Shapes of a date.
DATE_SHAPE = (
    r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d"
)


def clean(text: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def query_terms(text: Column) -> Column:
    """Distinct words in first-occurrence order, without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_except(F.array_distinct(words(text)), stop)


def key_name(text: Column) -> Column:
    """Replace each run of anything but letters, digits and _ by one _, trim _."""
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_]+", "_"), F.lit("_"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def norm(text: Column) -> Column:
    """Comparison form: lower-case letters, digits, % and . only."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9%.]", "")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\d")


def fill_template(text: Column, **values: Column) -> Column:
    """Replace ``{name}`` marks."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**30)).otherwise(text)


@F.pandas_udf(T.StringType())
def nfd(values: pd.Series) -> pd.Series:
    """Canonical decomposition (no built-in function does this)."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFD", s))


def rename_image_marks(text: Column) -> Column:
    """``<image 3>`` becomes ``[image 3]`` for marks 1 to 7."""
    return F.regexp_replace(text, r"<image ([1-7])>", "[image $1]")


def short_letter(reply: Column, k: Column | int) -> Column:
    """Leading letter A-L of a short reply, else the first free-standing one; null past k."""
    t = F.trim(F.coalesce(reply, F.lit("")))
    lead = F.regexp_extract(t, SHORT_LEAD, 1)
    letter = F.when(lead != "", lead).otherwise(F.regexp_extract(t, LONE_LETTER, 1))
    return _within(letter, k)


def long_letter(reply: Column, k: Column | int) -> Column:
    """Last letter stated as 'answer' or 'option' in a long reply, else the last free-standing one."""
    t = F.coalesce(reply, F.lit(""))
    stated = F.regexp_extract_all(t, F.lit(STATED_LETTER), 1)
    found = F.when(F.size(stated) > 0, stated).otherwise(F.regexp_extract_all(t, F.lit(LONE_LETTER), 1))
    return _within(F.upper(F.try_element_at(found, F.lit(-1))), k)


def _within(letter: Column, k: Column | int) -> Column:
    limit = k if isinstance(k, Column) else F.lit(k)
    return F.when((F.length(letter) > 0) & (F.ascii(letter) - 65 < limit), letter)


def amount(text: Column) -> Column:
    """Positive amount of money from receipt text; anything else is null.

    An amount in brackets or with a minus sign in front is a deduction, hence null.
    """

    def read(core: Column) -> Column:
        number = F.btrim(core, F.lit("-() "))
        return F.when(~core.rlike(r"^[-(]"), once(number, shaped))

    def shaped(number: Column) -> Column:
        return F.coalesce(*[F.when(number.rlike(shape), F.translate(number, old, new)) for shape, old, new in AMOUNT_SHAPES]).try_cast("double")

    value = once(F.regexp_extract(text, AMOUNT_CORE, 1), read)
    return once(value, lambda v: F.when(v > 0, v))


def amount_label(value: Column, decimals: Column) -> Column:
    """Thousands-separated text with two or no decimals."""
    return F.when(decimals, F.format_number(value, 2)).otherwise(F.format_number(F.bround(value, 0), 0))


def text_kind(text: Column) -> Column:
    """``date``, ``number`` or ``text``."""
    digits = F.regexp_count(text, F.lit(r"\p{Nd}"))
    alnum = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    mostly = (digits > 0) & (digits >= 0.5 * alnum)
    return F.when(text.rlike(DATE_SHAPE), "date").when(mostly, "number").otherwise("text")


def plain_number(value: Column) -> Column:
    """Decimal in fixed notation without trailing zeros."""
    s = value.cast("decimal(38,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """Colour in [0,1] channels as #rrggbb (halves round to even)."""
    parts = [F.lpad(F.lower(F.hex(F.bround(c * 255, 0).cast("bigint"))), 2, "0") for c in (r, g, b)]
    return F.concat(F.lit("#"), *parts)
