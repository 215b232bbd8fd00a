"""Column builders that read numbers, prices and URLs out of text. NULL in, NULL out unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercanta.functions.text import spaces


def localized(number: Column) -> Column:
    """A number with Brazilian marks as double: both marks, or only dots before groups of three, part thousands."""
    both = number.contains(",") & number.contains(".")
    plain = F.when(both, F.translate(number, ",.", ".")).when(number.rlike(r"^\d+(?:\.\d{3})+$"), F.replace(number, F.lit("."))).otherwise(F.translate(number, ",", "."))
    return plain.try_cast("double")


def brl_price(text: Column) -> Column:
    """The first price after ``R$``. Dots are taken as thousands marks even in ``R$ 12.99`` (1299.0), as the sources' parser does."""
    found = F.regexp_extract(spaces(text), r"R\$\s*([0-9.]+,\d{2}|[0-9]+(?:[.,]\d{2})?)", 1)
    return F.translate(found, ",.", ".").try_cast("double")


def brl_price_with_cents(text: Column) -> Column:
    """The first price that has two digits after a comma, as supplier pages state it."""
    found = F.regexp_extract(spaces(text), r"(\d[\d.]*,\d{2})", 1)
    return F.translate(found, ",.", ".").try_cast("double")


def int_text(text: Column) -> Column:
    """The first number, times 1000 after ``mil`` or ``k``, truncated."""
    low = F.lower(spaces(text))
    pattern = r"(\d+(?:[.,]\d+)?)\s*(mil|k)?"
    times = F.when(F.regexp_extract(low, pattern, 2) != "", 1000).otherwise(1)
    return (localized(F.regexp_extract(low, pattern, 1)) * times).cast("bigint")


def sold_quantity(text: Column) -> Column:
    """Pieces sold as the collectors read them: a number before ``vendid`` or ``compras``; other units are ignored (see problem 4)."""
    low = F.lower(spaces(text))
    sold, bought = r"(\d[\d.,]*)\s*(mil|k)?\+?\s*vendid", r"(\d[\d.,]*)\s*(mil|k)?\+?\s+compras?"
    pattern_hit = low.rlike(sold)
    number = F.when(pattern_hit, F.regexp_extract(low, sold, 1)).otherwise(F.regexp_extract(low, bought, 1))
    scale = F.when(pattern_hit, F.regexp_extract(low, sold, 2)).otherwise(F.regexp_extract(low, bought, 2))
    told = low.contains("vend") | low.contains("sold") | low.contains("compras")
    return F.when(told, (localized(number) * F.when(scale != "", 1000).otherwise(1)).cast("bigint"))


def to_double(text: Column) -> Column:
    """Text as double: ``R$`` and blanks dropped, Brazilian marks where a comma occurs; NaN and infinity are NULL."""
    bare = F.replace(F.replace(spaces(text), F.lit("R$")), F.lit(" "))
    marked = F.when(bare.contains(",") & bare.contains("."), F.translate(bare, ",.", ".")).otherwise(F.translate(bare, ",", "."))
    number = marked.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def to_int(text: Column) -> Column:
    return to_double(text).cast("bigint")


def to_flag(text: Column) -> Column:
    """True for 1, true, yes and sim in any case; False for all else, NULL included."""
    return F.coalesce(F.lower(spaces(text)).isin("1", "true", "yes", "sim"), F.lit(False))


def money(value: Column) -> Column:
    """Two decimals as text; NULL is empty text."""
    return F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double"))).otherwise(F.lit(""))


def rating(text: Column) -> Column:
    """The first digit from 0 to 5, with one decimal if it has one, not above 5; else NULL."""
    found = F.translate(F.regexp_extract(spaces(text), r"([0-5](?:[.,]\d)?)", 1), ",", ".").try_cast("double")
    return F.when(found <= 5, found)


def bare_url(url: Column) -> Column:
    """Scheme, host and path only; texts that are no absolute URL stay as they are, trimmed."""
    u = spaces(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)"
    return F.when(u.rlike(pattern), F.concat(F.regexp_extract(u, pattern, 1), F.regexp_extract(u, pattern, 2))).otherwise(u)


def search_url(template: str, query: Column) -> Column:
    """A search URL from a template with ``{query}``; the query is form-encoded."""
    return F.replace(F.lit(template), F.lit("{query}"), F.url_encode(query))


def json_int(html: Column, key: str) -> Column:
    """The integer of ``"key": n`` anywhere in a page; ``null`` and absence are NULL."""
    return F.regexp_extract(html, rf'"{key}"\s*:\s*(\d+)', 1).try_cast("bigint")


def first_of(*columns: Column) -> Column:
    """The first column that is neither NULL nor blank text."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def first_truthy(columns: Sequence[Column]) -> Column:
    """The first number that is neither NULL nor 0, as ``or`` chains pick it."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns))


def any_price(text: Column) -> Column:
    """A price in plain or in Brazilian form: plain first."""
    return F.coalesce(spaces(text).try_cast("double"), to_double(text))


def elapsed(seconds: Column) -> Column:
    """A duration as short text: seconds, minutes, hours or days, whole ones; NULL is a dash."""
    whole = lambda per, unit: F.concat(F.floor(seconds / per).cast("string"), F.lit(unit))
    return F.when(seconds.isNull(), "-").when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "min")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))
