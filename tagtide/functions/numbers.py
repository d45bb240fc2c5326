"""Rounding, masks, snowflake ids and response-header values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_up_half(value: Column, digits: int = 1) -> Column:
    """Round with halves going up, also below zero."""
    if digits == 0:
        return F.floor(value + 0.5)
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def popcount(mask: Column) -> Column:
    return F.when(mask < 0, F.lit(0)).otherwise(F.bit_count(mask))


def bit_mask(bit: Column) -> Column:
    """One server's mask; a server without a bit contributes nothing, a bit outside 0 to 62 is an error."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    wrong = F.raise_error(F.concat(F.lit("no mask has bit "), bit.cast("string"))).cast("bigint")
    return F.when(bit.isNull(), F.lit(0).cast("bigint")).when(bit.between(0, 62), mask).otherwise(wrong)


def mask_bits(mask: Column, width: int = 63) -> Column:
    """Positions of the set bits, ascending."""
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    one = F.lit(1).cast("bigint")
    return F.filter(positions, lambda b: F.call_function("shiftrightunsigned", mask, b).bitwiseAND(one) == 1)


def minute_of(seconds: Column) -> Column:
    return F.floor(seconds / 60)


def snowflake(text: Column) -> Column:
    """Numeric value of a decimal id that may outrun 64 bits; malformed ids are NULL."""
    return F.when(text.rlike(r"\A\d+\z"), text.try_cast("decimal(38,0)"))


def previous_page_cursor(link_header: Column) -> Column:
    """``min_id`` of the rel=prev entry of a Link header, else NULL."""
    parts = F.filter(F.split(link_header, ","), lambda p: p.rlike(r'rel\s*=\s*"?prev"?') & p.rlike("<[^>]+>"))
    target = F.regexp_extract(F.get(parts, F.lit(0)), "<([^>]+)>", 1)
    query = F.regexp_extract(target, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+[^?#]*\?([^#]*)", 1)
    found = F.regexp_extract(query, r"(?:^|&)min_id=([^&]*)", 1)
    has = query.rlike(r"(?:^|&)min_id=")
    return F.when(has, F.try_url_decode(found))


def header_int(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def reset_seconds(text: Column) -> Column:
    """A rate-limit reset given as an ISO time or as epoch seconds."""
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.unix_seconds(F.try_to_timestamp(text)))
    plain = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.floor(F.trim(text).try_cast("double")))
    return F.coalesce(iso, plain)
