"""Pseudorandom numbers from ids, in arithmetic that every SQL dialect has.

Multiplications modulo a prime below 2^31, with shifted bits folded in between, so that no product
leaves a BIGINT.  The same numbers come out in any engine, however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = (1 << 31) - 1
_FACTORS = (48271, 69621, 16807, 39373)  # fixed values: multipliers of full period modulo the prime


def _scrambled(value: str, seed: int, spark: bool) -> str:
    """SQL for a number below the prime, of a BIGINT expression that is not negative."""
    a, b, c, d = _FACTORS
    over = "div" if spark else "//"
    x = f"((({value}) % {_PRIME}) * {a} + (({value}) {over} {_PRIME}) % {_PRIME} * {b} + {(seed * 40692 + 11) % _PRIME}) % {_PRIME}"
    for factor, shift in ((c, 65536), (d, 8192)):
        fold = f"(({x}) ^ (({x}) div {shift}))" if spark else f"xor({x}, ({x}) // {shift})"
        x = f"(({fold} % {_PRIME}) * {factor} + {seed % 1009 + shift}) % {_PRIME}"
    return x


def below_sql(value: str, bound: str, seed: int, spark: bool = False) -> str:
    """SQL for a number from 0 to bound - 1; value and bound are BIGINT expressions."""
    return f"(({_scrambled(value, seed, spark)}) * CAST({_PRIME} AS BIGINT) + ({_scrambled(value, seed + 7919, spark)})) % ({bound})"


def below(value: str, bound: str, seed: int) -> Column:
    return F.expr(f"CAST({below_sql(value, bound, seed, True)} AS BIGINT)")
