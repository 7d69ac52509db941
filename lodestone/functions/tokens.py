"""Model input expressions over token id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(ids: Column, head: Column, tail: Column, middle: Column | None) -> Column:
    pieces = [F.slice(ids, F.lit(1), head)]
    if middle is not None:
        pieces.append(middle)
    pieces.append(F.slice(ids, F.size(ids) - tail + 1, tail))
    return F.concat(*pieces)


def head_and_tail(ids: Column, maximum: int, separator: int) -> Column:
    """Keep both ends of an over-long input around a separator token."""
    head = (maximum - 1 + 1) // 2
    tail = maximum - 1 - head
    cut = _part(ids, F.lit(head), F.lit(tail), F.array(F.lit(separator)).cast("array<bigint>"))
    return F.when(F.size(ids) <= maximum, ids).otherwise(cut)


def head_and_tail_static(ids: Column, maximum: int) -> Column:
    """The variant without a separator, for table-lookup models."""
    head = (maximum + 1) // 2
    cut = _part(ids, F.lit(head), F.lit(maximum - head), None)
    return F.when(F.size(ids) <= maximum, ids).otherwise(cut)


def padded(ids: Column, width: Column, padding: int) -> Column:
    missing = F.greatest(width - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(padding).cast("bigint"), missing))


def attention_mask(ids: Column, width: Column) -> Column:
    missing = F.greatest(width - F.size(ids), F.lit(0))
    return F.concat(
        F.array_repeat(F.lit(1).cast("bigint"), F.size(ids)),
        F.array_repeat(F.lit(0).cast("bigint"), missing),
    )
