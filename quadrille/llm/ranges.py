"""Buckets of neighbouring rows by ranges of integer keys, as constant bounds that every later plan can repeat."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(rows: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """Ascending first keys (of columns of type long, nulls first) of at most `parts` ranges with about as many rows.

    One row for each range reaches the driver.
    """
    dealt = rows.select(*keys).repartitionByRange(parts, *keys)
    least = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("b")).select("b.*").collect()
    return sorted((tuple(r) for r in least), key=lambda b: [(x is not None, x or 0) for x in b])


def _constant(of: list[tuple], keys: list[str]) -> Column:
    """Bounds as one constant array of structs, whatever their number (the optimizer folds it into a literal)."""
    text = json.dumps([dict(zip(keys, b, strict=True)) for b in of])
    return F.from_json(F.lit(text), f"array<struct<{','.join(f'{k}:bigint' for k in keys)}>>")


def bucket(of: list[tuple], keys: list[str]) -> Column:
    """Number of the range that a row's keys are in, from 0: a two-level search in the constant bounds."""
    inner = of[1:]
    if not inner:
        return F.lit(0)
    key = F.struct(*[F.col(k).alias(k) for k in keys])
    step = max(1, int(len(inner) ** 0.5))
    coarse, fine = _constant(inner[::step], keys), _constant(inner, keys)
    at = F.size(F.filter(coarse, lambda b: b <= key))
    part = F.slice(fine, F.greatest(at - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + F.size(F.filter(part, lambda b: b <= key)))


def first_key(of: list[tuple], keys: list[str], number: Column) -> Column:
    """The first key of a numbered range as a struct; null for the first range."""
    inner = of[1:]
    return F.get(_constant(inner, keys), number - 1) if inner else F.lit(None).cast(f"struct<{','.join(f'{k}:bigint' for k in keys)}>")
