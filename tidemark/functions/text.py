"""Column expressions for vendor text: blanks, strict dates and numbers, names and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.params import LEGAL_WORDS

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def blank_to_null(value: Column) -> Column:
    """Trimmed text; empty and "N/A" (any case) are no value."""
    text = F.trim(value)
    return F.when(F.upper(text).isin("", "N/A"), None).otherwise(text)


def strict_date(value: Column) -> Column:
    """The ISO date in the text, NULL when blank or not a full ISO date."""
    text = blank_to_null(value)
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def strict_decimal(value: Column, kind: str = "decimal(38,8)") -> Column:
    """The finite number in the text, NULL when blank or not a number."""
    return blank_to_null(value).try_cast(kind)


def is_bad(value: Column, parsed: Column) -> Column:
    """Text was given but could not be read: an error, unlike a blank."""
    return blank_to_null(value).isNotNull() & parsed.isNull()


def normalise_ticker(value: Column) -> Column:
    """Upper case without outer blanks; an empty ticker is NULL."""
    return F.nullif(F.upper(F.trim(value)), F.lit(""))


def normalise_symbol(value: Column) -> Column:
    """One spelling for share classes across vendors: BRK-B and BRK/B become BRK.B."""
    return F.translate(F.upper(F.trim(value)), "-/", "..")


def sic_number(value: Column) -> Column:
    return F.trim(value).try_cast("int")


def company_key(name: Column) -> Column:
    """Upper case with single blanks."""
    return F.trim(F.regexp_replace(F.upper(name), r"\s+", " "))


def name_key(name: Column) -> Column:
    """A company name without punctuation and legal words."""
    spelled = F.replace(F.replace(F.upper(name), F.lit("&"), F.lit(" AND ")), F.lit("/"), F.lit(" "))
    words = F.split(F.trim(F.regexp_replace(spelled, "[^A-Z0-9 ]", " ")), " +")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_WORDS)), " ")


def related_set(value: Column) -> Column:
    """The related tickers as a sorted, distinct, upper-case array ("N/A" dropped)."""
    words = F.split(F.trim(F.upper(F.coalesce(value, F.lit("")))), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin("", "N/A"))))
