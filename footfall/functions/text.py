"""Text and number rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser's trim() removes.
_BLANKS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
_FILLER = "￿"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_left(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; half a character at the cut is dropped."""
    spaced = F.regexp_replace(text, f"({_ASTRAL})", f"$1{_FILLER}")
    cut = F.regexp_replace(F.left(spaced, F.lit(units)), f"{_ASTRAL}$", "")
    return (
        F.when(F.octet_length(text) <= units, text)
        .when(~text.rlike(_ASTRAL), F.left(text, F.lit(units)))
        .otherwise(F.regexp_replace(cut, _FILLER, ""))
    )


def epoch_micros(timestamp: str) -> Column:
    """Microseconds of a time without zone since 1970, whatever the session's time zone is."""
    return F.expr(
        f"unix_date(CAST({timestamp} AS DATE)) * 86400000000L + hour({timestamp}) * 3600000000L"
        f" + minute({timestamp}) * 60000000L + CAST(extract(SECOND FROM {timestamp}) * 1000000 AS BIGINT)"
    )


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANKS}+|{_BLANKS}+$", "")


def present(text: Column) -> Column:
    """Neither NULL nor empty; never NULL itself."""
    return text.isNotNull() & (text != "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def round_half_up(number: Column) -> Column:
    """Round halves towards positive infinity, so -12.5 becomes -12."""
    return F.floor(number + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` as a percentage with two decimals; a zero ``whole`` counts as one."""
    ratio = part / F.greatest(whole, F.lit(1)).cast("double")
    return round_half_up(ratio * 10000) / F.lit(100.0)


def iso_date(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd")
