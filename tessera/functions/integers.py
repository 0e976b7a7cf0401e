"""Integer rules of timing, depth and alpha as Columns. Division truncates toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, truncated toward zero; null if b is 0."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(b != 0, F.call_function("div", a, b))


def ticks_to_ms(ticks: Column, timescale: Column | int) -> Column:
    """Milliseconds of ticks, rounded half up."""
    ts = timescale if isinstance(timescale, Column) else F.lit(timescale).cast("long")
    return div(ticks * 1000 + div(ts, 2), ts)


def rescale(v: Column, from_max: int, to_max: int) -> Column:
    """A sample scaled between depths given by their largest values, rounded half up."""
    return div(v * to_max + from_max // 2, from_max)


def to_16_bit(v: Column, depth: int) -> Column:
    """8-bit samples are replicated into both bytes, others scaled."""
    return v * 257 if depth == 8 else rescale(v, (1 << depth) - 1, 65535)


def to_8_bit(v16: Column) -> Column:
    """8-bit value of a 16-bit sample."""
    return div(v16 * 255 + 32767, 65535)


def unpremultiply(c: Column, a: Column, top: int) -> Column:
    """Colour before alpha was multiplied in; 0 where alpha is 0."""
    return F.when(a == 0, F.lit(0).cast("long")).otherwise(F.least(div(c * top + div(a, 2), a), F.lit(top).cast("long")))


def order_distance(a: Column, b: Column, bits: int) -> Column:
    """Signed distance of order hints modulo 2^bits."""
    half = 1 << (bits - 1)
    d = a - b
    return d.bitwiseAND(F.lit(half - 1).cast("long")) - d.bitwiseAND(F.lit(half).cast("long"))


def loop_count(kind: Column, n: Column) -> Column:
    """Loops of a repetition: finite n, infinite 0, unknown 1."""
    return F.when(kind == "finite", n).when(kind == "infinite", F.lit(0)).otherwise(F.lit(1)).cast("long")
