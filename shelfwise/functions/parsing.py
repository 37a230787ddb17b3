"""Row-level parsing of landed strings. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import params

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """Trimmed number, scientific notation included; anything else is null."""
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd or M/d/yyyy; anything else is null."""
    t = F.trim(c)
    us = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    parts = F.concat_ws("-", F.regexp_extract(t, us, 3), F.lpad(F.regexp_extract(t, us, 1), 2, "0"),
                        F.lpad(F.regexp_extract(t, us, 2), 2, "0"))
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date")).when(t.rlike(us), parts.try_cast("date"))


def boolean(c: Column) -> Column:
    u = F.upper(F.trim(c))
    return F.when(u.isin("TRUE", "YES"), True).when(u.isin("FALSE", "NO"), False)


def yes(c: Column) -> Column:
    """Only 'Y' is true; missing is false."""
    return F.coalesce(F.upper(F.trim(c)) == "Y", F.lit(False))


def location_code(c: Column) -> Column:
    """'25-Main - DC' -> 'LOC-025'; text without a leading number is kept."""
    head = F.trim(F.split_part(c, F.lit("-"), F.lit(1)))
    digits = F.regexp_replace(head, "^0+(?=[0-9])", "")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.when(head.rlike("^[0-9]+$"), F.concat(F.lit("LOC-"), padded)).otherwise(c)


def tran_code(c: Column) -> Column:
    return F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(" - "), F.lit(1)))


def meaningful(c: Column, tokens: tuple[str, ...] = params.NULLISH_TOKENS) -> Column:
    """Trimmed text, null when blank or a placeholder."""
    t = F.trim(c)
    return F.when((t != "") & ~t.isin(*tokens), t)


def sale_id(day: Column, sku: Column, location: Column, invoice: Column) -> Column:
    base = F.concat_ws("-", F.lit("AC"), day.cast("string"), sku, location)
    return F.when(F.coalesce(invoice, F.lit("")) != "", F.concat(base, F.lit("-INV"), invoice)).otherwise(base)


def detail_id(day: Column, location: Column, code: Column, ship_to: Column, part: Column) -> Column:
    """First 20 hex digits of the SHA-1 of the natural key, so a reload writes the same row."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (day, location, code, ship_to, part)]
    return F.concat(F.lit("SDT-"), F.substring(F.sha1(F.concat_ws("|", *text)), 1, 20))


def transfer_ends(invoice: Column) -> tuple[Column, Column]:
    """(from, to) of an invoice 'T2501'; nulls when it is not a transfer."""
    pattern = r"^T([0-9]{2})([0-9]{2})$"
    t = F.trim(invoice)
    ends = [F.when(t.rlike(pattern), F.concat(F.lit("LOC-0"), F.regexp_extract(t, pattern, g))) for g in (1, 2)]
    return ends[0], ends[1]


def measured(c: Column) -> Column:
    return F.bround(c.try_cast("double"), 4)


def spreadsheet_safe(c: Column) -> Column:
    """Text a spreadsheet cannot take for a formula."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
