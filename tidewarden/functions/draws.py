"""Repeatable pseudo-random draws from md5.

``rand()`` changes with the partitioning; these draws depend on the row's key
and a salt only, so a retried task gives the same rows and any SQL engine can
recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(key: Column, salt: str) -> Column:
    """32 hex digits for one row and one purpose."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))


def draw(hexes: Column, slot: int) -> Column:
    """The slot-th (0..3) 32-bit number of a digest, as a long."""
    return F.conv(F.substring(hexes, 8 * slot + 1, 8), 16, 10).cast("long")


def below_rate(number: Column, percent: float) -> Column:
    """True for ``percent`` % of uniform 32-bit numbers."""
    return number < F.lit(round(percent / 100.0 * 2 ** 32))


def below_rate_hex(hexes: Column, slot: int, percent: float) -> Column:
    """``below_rate(draw(hexes, slot), percent)``, told from the digits: of equal length, they sort like the numbers."""
    bound = round(percent / 100.0 * 2 ** 32)
    return F.lit(True) if bound >= 2 ** 32 else F.substring(hexes, 8 * slot + 1, 8) < F.lit(f"{bound:08x}")


def choice(values: list[str], number: Column) -> Column:
    """Uniform pick from a short list."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (number % len(values) + 1).cast("int"))


def weighted_choice(pairs: list[tuple[object, float]], number: Column) -> Column:
    """Pick with weights that add up to one."""
    total, picked = 0.0, None
    for value, weight in pairs[:-1]:
        total += weight
        bound = number < F.lit(round(total * 2 ** 32))
        picked = F.when(bound, F.lit(value)) if picked is None else picked.when(bound, F.lit(value))
    last = F.lit(pairs[-1][0])
    return last if picked is None else picked.otherwise(last)
