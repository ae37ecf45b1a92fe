"""Counter-based random numbers: a PCG hash of (seed, index), as column expressions.

The same seed and index give the same number on any cluster; no state is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError

MASK = 0xFFFFFFFF
#: Fixed values of the hash.
MULTIPLIER, INCREMENT, WORD = 747796405, 2891336453, 277803737
#: Fixed value: the stream of a second number for the same index.
SECOND = 0x9E3779B9


def _m(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK).cast("long"))


def pcg(x: Column) -> Column:
    """The 32-bit hash of an unsigned 32-bit number held in a long; products stay below 2**63."""
    state = _m(x * F.lit(MULTIPLIER).cast("long") + F.lit(INCREMENT).cast("long"))
    shift = (F.shiftright(state, 28) + 4).cast("int")
    shifted = F.call_function("shiftright", state, shift)
    word = _m(shifted.bitwiseXOR(state) * F.lit(WORD).cast("long"))
    return F.shiftright(word, 22).bitwiseXOR(word)


def pcg_int(x: int) -> int:
    """The same of a Python integer."""
    state = (x * MULTIPLIER + INCREMENT) & MASK
    word = (((state >> ((state >> 28) + 4)) ^ state) * WORD) & MASK
    return (word >> 22) ^ word


def key(seed: int) -> int:
    """32 bits of a 64-bit seed."""
    return pcg_int((seed & MASK) ^ pcg_int(seed >> 32 & MASK))


def draw(index: Column, seed: int, stream: int = 0) -> Column:
    """32 random bits, by index, of one of the seed's streams."""
    return pcg(_m(index).bitwiseXOR(F.lit(key(seed) ^ stream).cast("long")))


def _check(low, high) -> None:
    if not low <= high:
        raise InvalidArgumentError(f"the range must satisfy low <= high, not {low} and {high}")


def uniform_u32(index: Column, low: int, high: int, seed: int) -> Column:
    """low to high, both included."""
    _check(low, high)
    span = high - low + 1
    word = draw(index, seed)
    return word if span > MASK else word % F.lit(span).cast("long") + F.lit(low).cast("long")


def _draw64(index: Column, seed: int) -> Column:
    """64 random bits as a decimal; the second stream's draw is the high half."""
    big = F.lit(1 << 32).cast("decimal(10,0)")
    return (draw(index, seed, SECOND).cast("decimal(10,0)") * big + draw(index, seed).cast("decimal(10,0)")).cast("decimal(20,0)")


def uniform_u64(index: Column, low: int, high: int, seed: int) -> Column:
    """low to high, both included, as decimal(20,0)."""
    _check(low, high)
    span = high - low + 1
    if span > (1 << 64) - 1:
        return _draw64(index, seed)
    return (_draw64(index, seed) % F.lit(str(span)).cast("decimal(20,0)") + F.lit(str(low)).cast("decimal(20,0)")).cast("decimal(20,0)")


def uniform_f32(index: Column, low: float, high: float, seed: int) -> Column:
    """low + u * (high - low) in single precision, u from the top 24 bits."""
    _check(low, high)
    unit = (F.shiftright(draw(index, seed), 8).cast("float") * F.lit(2.0**-24).cast("float")).cast("float")
    least, most = F.lit(low).cast("float"), F.lit(high).cast("float")
    return (least + unit * (most - least)).cast("float")


def uniform_f64(index: Column, low: float, high: float, seed: int) -> Column:
    """low + u * (high - low), u from the top 53 of 64 bits."""
    _check(low, high)
    bits = draw(index, seed, SECOND) * F.lit(1 << 21).cast("long") + F.shiftright(draw(index, seed), 11)
    return F.lit(float(low)) + bits.cast("double") * F.lit(2.0**-53) * F.lit(float(high - low))


def _normal(index: Column, seed: int) -> Column:
    """Box-Muller, cosine branch, of two draws from the open unit interval, in single precision."""

    def open_unit(stream: int) -> Column:
        bits = (F.shiftright(draw(index, seed, stream), 8).cast("double") + F.lit(0.5)).cast("float")
        return bits.cast("double") * F.lit(2.0**-24)

    radius = F.sqrt(F.lit(-2.0) * F.log(open_unit(0))).cast("float")
    turn = F.cos((F.lit(6.283185307179586).cast("float") * open_unit(SECOND).cast("float")).cast("double")).cast("float")
    return (radius * turn).cast("float")


def normal_f32(index: Column, mean: float, deviation: float, seed: int) -> Column:
    return (F.lit(mean).cast("float") + F.lit(deviation).cast("float") * _normal(index, seed)).cast("float")


def normal_f64(index: Column, mean: float, deviation: float, seed: int) -> Column:
    """As normal_f32, widened at the end."""
    return F.lit(float(mean)) + F.lit(float(deviation)) * _normal(index, seed).cast("double")
