"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplying by 2^27 + 1 cuts a double into two halves whose products with a
# small power of ten are exact.
_SPLITTER = 134217729.0


# From here on a double has no fraction and may not fit a BIGINT.
_LARGE = float(2**63)
_PART = float(2**62)


def fixed_point(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals, correctly rounded.

    Rounds the binary value itself and sends exact halves to the even
    neighbour, as C's printf does. ``format_string`` rounds the shortest decimal
    form half up, so it differs on values like 0.125 and 1.005. Exact below
    1e37; beyond, the digits after the 17th are zeros. NaN gives ``nan``, the
    infinities ``inf`` and ``-inf``.
    """
    x = F.abs(value.cast("double"))
    scale = 10**digits
    # The whole part and the fraction of a double are exact; only the latter is scaled.
    whole = F.floor(x)
    part = x - whole
    spread = part * _SPLITTER
    high = spread - (spread - part)
    low = part - high
    below = F.floor(part * scale)
    past_half = (high * scale - below - 0.5) + low * scale
    odd = (whole % 2 == 1) if digits == 0 else (below % 2 == 1)
    up = (past_half > 0) | ((past_half == 0) & odd)
    units = below + F.when(up, 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    decimals = [F.lit("."), F.lpad((units % scale).cast("string"), digits, "0")] if digits else []
    small = F.concat(sign, (whole + F.floor(units / scale)).cast("string"), *decimals)

    # Two parts that fit a BIGINT each, exactly.
    upper = F.floor(x / _PART)
    lower = F.floor(x - upper.cast("double") * _PART)
    # A product of DECIMAL(19) and DECIMAL(19) is a DECIMAL(38) or more, cut there.
    number = upper.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + lower.cast("decimal(19,0)")
    zeros = F.lit("." + "0" * digits if digits else "")
    large = F.concat(sign, number.cast("decimal(38,0)").cast("string"), zeros)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value.cast("double")), "nan")
        .when(x == float("inf"), F.concat(sign, F.lit("inf")))
        .when(x < _LARGE, small)
        .when(x < 1e37, large)
        .otherwise(F.format_string(f"%.{digits}f", value.cast("double")))
    )


def percent(value: Column, digits: int) -> Column:
    """A ratio as a percentage with ``digits`` decimals."""
    return F.concat(fixed_point(value.cast("double") * 100.0, digits), F.lit("%"))


def round_half_even(value: Column, digits: int) -> Column:
    """``value`` rounded like :func:`fixed_point`, as a number."""
    return fixed_point(value, digits).cast("double")
