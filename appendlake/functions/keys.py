"""Partition keys as built-in column expressions, so that they stay in code generation and can be pushed down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mono_bucket(name: str, width: int, decimal: bool = False) -> Column:
    """floor(column / width), exact for all integers and decimals, negative ones too."""
    c, n = _quoted(name), f"{width}{'' if decimal else 'L'}"
    return F.expr(f"cast(({c} - pmod({c}, {n})) div {n} as bigint)")


def time_keys(name: str, parts: tuple[str, ...], zone: str | None = None) -> dict[str, Column]:
    """year, month and day of a date or zone-less timestamp, or of an instant in `zone`, whatever the session's zone is."""
    made, c = {"year": F.year, "month": F.month, "day": F.dayofmonth}, F.col(_quoted(name))
    if zone is not None:
        c = F.expr(f"convert_timezone('UTC', '{zone}', timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(unix_micros({_quoted(name)}) as decimal(38, 0)) / 1000000))")
    return {p: made[p](c).cast("int") for p in parts}


def padded_number(c: Column, width: int | None, signed: bool) -> Column:
    """Base-10 text of a number, its digits filled with zeros to a whole width (the sign included, when signed)."""
    negative = c < 0
    digits = F.regexp_replace(c.cast("string"), "^-", "")
    if not signed:
        return digits if not width else F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    if width:
        digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(width) - F.length(sign)), F.lit("0"))
    return F.concat(sign, digits)


def char_keys(text: Column, depth: int) -> dict[str, Column]:
    """char0, char1, ...: single characters, empty past the end, null for null."""
    return {f"char{i}": F.substring(text, i + 1, 1) for i in range(depth)}
