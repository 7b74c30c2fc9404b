"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join in which NULL keys match; keeps the left columns and the right's own."""
    same = reduce(lambda a, b: a & b,
                  [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
    joined = left.alias("l").join(right.alias("r"), same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    own = [F.col(f"r.`{c}`") for c in right.columns if c not in keys]
    return joined.select("l.*", *own)
