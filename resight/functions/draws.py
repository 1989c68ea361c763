"""Reproducible draws: a row's draw depends on the seed and its key, not on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from resight.functions.mathx import as_col

UNIFORM_HEX_DIGITS = 13
UNIFORM_SCALE = float(16**UNIFORM_HEX_DIGITS)


def uniform(seed, *keys) -> Column:
    """A number in [0, 1) from the digest of ``seed:key:key``; null keys read as NA."""
    parts = [F.lit(str(seed))] + [F.coalesce(as_col(k).cast("string"), F.lit("NA")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, UNIFORM_HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(UNIFORM_SCALE)


def standard_normal(seed, *keys) -> Column:
    radius = F.sqrt(-2 * F.log(1 - uniform(f"{seed}r", *keys)))
    return radius * F.cos(2 * math.pi * uniform(f"{seed}a", *keys))


def pick(u, choices) -> Column:
    """Label whose cumulative share first exceeds ``u``; ``choices`` is [(label, weight)].

    Weights are normalised; null when they sum to nothing.
    """
    u = as_col(u)
    weights = [F.coalesce(as_col(w), F.lit(0.0)) for _, w in choices]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    reach, out = F.lit(0.0), None
    for (label, _), w in zip(choices[:-1], weights[:-1]):
        reach = reach + w
        test = u * total < reach
        out = F.when(test, label) if out is None else out.when(test, label)
    last = choices[-1][0]
    out = F.lit(last) if out is None else out.otherwise(F.lit(last))
    return F.when(total > 0, out)
