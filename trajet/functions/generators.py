"""A 32-bit counter-based generator as a column, so that any draw of a seed is had by its number."""

from __future__ import annotations

from pyspark.sql import functions as F

# The step of the state and the constants of its mixing.
STEP, ODD, MIX = 0x6D2B79F5, 1, 61
_MASK, _SPAN = 0xFFFFFFFF, 2**32


def _times(x, y):
    """The lower 32 bits of a product of two numbers below 2**32, inside a long."""
    high = (x * F.shiftrightunsigned(y, 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + x * y.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(_MASK))


def draw32(seed: int, n):
    """The n-th draw (from 0) of the generator with this seed, below 2**32. The state is a sum, so it needs no draw before."""
    mask = F.lit(_MASK).cast("long")
    n = n.cast("long")
    state = (((n + 1) % _SPAN) * F.lit(STEP).cast("long") + F.lit(seed % _SPAN).cast("long")).bitwiseAND(mask)
    shifted = lambda t, k: F.shiftrightunsigned(t, k)
    t = _times(state.bitwiseXOR(shifted(state, 15)), state.bitwiseOR(F.lit(ODD).cast("long")))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(shifted(t, 7)), t.bitwiseOR(F.lit(MIX).cast("long")))).bitwiseAND(mask))
    return t.bitwiseXOR(shifted(t, 14))


def draw(seed: int, n):
    """draw32 as a double in [0, 1)."""
    return draw32(seed, n) / F.lit(float(_SPAN))


def draws_sql(numbers: str, seed: int, name: str = "dr") -> str:
    """CTEs that end in `name`(n, u) for a query of n: what draw() says, in DuckDB."""
    times = lambda x, y: f"(({x})::HUGEINT * ({y})) % {_SPAN}"
    return f"""{name}_s AS (SELECT n, (({seed} + (n + 1)::HUGEINT * {STEP}) % {_SPAN})::BIGINT AS s FROM ({numbers})),
    {name}_t AS (SELECT n, ({times("xor(s, s >> 15)", f"s | {ODD}")})::BIGINT AS t FROM {name}_s),
    {name}_v AS (SELECT n, xor(t, ((t + {times("xor(t, t >> 7)", f"t | {MIX}")}) % {_SPAN})::BIGINT) AS t FROM {name}_t),
    {name} AS (SELECT n, xor(t, t >> 14) / {_SPAN}.0::DOUBLE AS u FROM {name}_v)"""
