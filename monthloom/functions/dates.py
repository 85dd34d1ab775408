"""Parts of dates as the registers write them; malformed text gives nulls, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as register A writes them.
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def month_idx(year: Column, month: Column) -> Column:
    """Months since year 0, so that differences are numbers of months."""
    return (year * 12 + month).cast("int")


def day_month_year(text: Column) -> dict[str, Column]:
    """day, month, year of DD-MON-YY; two-digit years from 78 on are 19xx, others 20xx; years of four digits stay."""
    part = F.split(text, "-")
    ok = F.size(part) == 3
    mon = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.upper(F.get(part, F.lit(1)))).cast("int")
    year = F.get(part, F.lit(2)).try_cast("int")
    full = F.when(year.between(78, 99), 1900 + year).when(year < 78, 2000 + year).otherwise(year)
    return {"day": F.when(ok, F.get(part, F.lit(0)).try_cast("int")), "month": F.when(ok, F.nullif(mon, F.lit(0))), "year": F.when(ok, full)}


def slashed(text: Column) -> dict[str, Column]:
    """month, day, year of MM/DD/YYYY."""
    part = F.split(text, "/")
    ok = F.size(part) == 3
    return {name: F.when(ok, F.get(part, F.lit(i)).try_cast("int")) for i, name in enumerate(("month", "day", "year"))}


def yyyymm(number: Column) -> dict[str, Column]:
    """year and month of a number yyyymm."""
    n = number.try_cast("int")
    return {"year": F.floor(n / 100).cast("int"), "month": (n % 100).cast("int")}


def entity_month(packed: Column) -> dict[str, Column]:
    """entity, year, month of a key `entity year/month`, read from the right since entities may hold blanks; nulls if it isn't one."""
    pattern = r"^(.*) (\d+)/(\d+)$"
    hit = packed.rlike(pattern)
    return {"entity": F.when(hit, F.regexp_extract(packed, pattern, 1)), "year": F.when(hit, F.regexp_extract(packed, pattern, 2).try_cast("int")), "month": F.when(hit, F.regexp_extract(packed, pattern, 3).try_cast("int"))}
