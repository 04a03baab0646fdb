"""Global row numbers, running sums and order statistics without a single task for all rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Ranges that rows are windowed in, and sampled rows for each; the driver holds the sample and a row for each range.
PARTS, SAMPLES = 256, 16
#: Values that the driver sorts at the end of the search for an order statistic, at most.
HELD = 1 << 17
_WIDTH = 16


class Cuts:
    """Sorted keys that cut rows into ranges: a row's range is the number of keys below its own (order, ties)."""

    def __init__(self, df: DataFrame, columns: list[str], parts: int = PARTS) -> None:
        self.columns = columns
        self.schema: StructType = df.select(*columns).schema
        keys = df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"), F.struct(*columns).alias("key"))
        sample = keys.orderBy(F.rand(17)).limit(parts * SAMPLES)  # any keys make right ranges; those of a sample make even ones
        listed = [r["json"] for r in sample.orderBy("key").collect()]
        self.keys = list(dict.fromkeys(listed[i * len(listed) // parts] for i in range(1, parts))) if listed else []

    def _array(self, nested: bool, content: list) -> Column:
        kind = ArrayType(ArrayType(self.schema)) if nested else ArrayType(self.schema)
        return F.from_json(F.lit(json.dumps(content)), kind)

    def range_of(self) -> Column:
        """A look at every _WIDTH-th key, then at those between two."""
        if not self.keys:
            return F.lit(0)
        key = F.struct(*self.columns)
        below = lambda some: F.size(F.filter(some, lambda c: key > c))
        parsed = [json.loads(k) for k in self.keys]
        heads = parsed[_WIDTH - 1 :: _WIDTH]
        groups = [parsed[i : i + _WIDTH - 1] for i in range(0, len(parsed) + 1, _WIDTH)]
        coarse = below(self._array(False, heads))
        return coarse * _WIDTH + below(F.element_at(self._array(True, groups), coarse + 1))


def numbered(df: DataFrame, order: str, ties: list[str], sums: dict[str, Column] | None = None, parts: int = PARTS, cuts: Cuts | None = None) -> DataFrame:
    """df with row_index (from 1, in the order of a column, then ties) and running sums by name.

    Rows are windowed within ranges of (order, ties), so that equal values of the order column spread over tasks; totals of
    the ranges in front are added. Cuts of the same columns can be used again.
    """
    sums = sums or {}
    cuts = cuts or Cuts(df, [order, *ties], parts)
    ranged = df.withColumn("_range", cuts.range_of()).withColumns({f"_{k}": v for k, v in sums.items()})
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(f"_{k}").alias(f"_total_{k}") for k in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range: at most `parts`
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    here = Window.partitionBy("_range").orderBy(order, *ties)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), "_range")
    out = out.withColumns({"row_index": F.row_number().over(here) + F.col("_before"), **{k: F.sum(f"_{k}").over(so_far) + F.col(f"_before_{k}") for k in sums}})
    return out.drop("_range", "_before", *[f"_{k}" for k in sums], *[f"_before_{k}" for k in sums])


def _search(part: DataFrame, n: int, k: int, held: int) -> float:
    """The k-th smallest (from 0) of n values v: a sample brackets it, counts place it, until the driver can hold what is inside."""
    while n > held:
        sample = [r["v"] for r in part.orderBy(F.rand(19)).limit(PARTS * SAMPLES).orderBy("v").collect()]
        at, margin = k * len(sample) // n, max(1, len(sample) // 40)
        low, high = sample[max(0, at - margin)], sample[min(len(sample) - 1, at + margin)]
        v = F.col("v")
        below, inside = part.agg(F.count_if(v < low), F.count_if(v.between(low, high))).first()
        if k < below:
            part, n = part.where(v < low), below
        elif k >= below + inside:
            part, n, k = part.where(v > high), n - below - inside, k - below - inside
        elif low == high:
            return low
        else:
            part, n, k = part.where(v.between(low, high)), inside, k - below
    return sorted(r["v"] for r in part.collect())[k]


def order_statistics(values: DataFrame, column: str, ranks: list[int], held: int = HELD) -> list[float | None]:
    """The k-th smallest values (from 0), exactly; None for a rank that isn't there."""
    present = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n = present.count()
    if n <= held:
        found = sorted(r["v"] for r in present.collect())
        return [found[k] if 0 <= k < n else None for k in ranks]
    return [_search(present, n, k, held) if 0 <= k < n else None for k in ranks]


def order_statistic(values: DataFrame, column: str, k: int) -> float | None:
    return order_statistics(values, column, [k])[0]


def upper_indexes(values: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """sorted(values)[int(n * fraction)] for each fraction."""
    present = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    head = sorted(r["v"] for r in present.limit(HELD + 1).collect())  # one job where the driver holds all
    if len(head) <= HELD:
        return [head[int(len(head) * f)] if head else None for f in fractions]
    n = present.count()
    return [_search(present, n, int(n * f), HELD) for f in fractions]


def upper_index(values: DataFrame, column: str, fraction: float) -> float | None:
    return upper_indexes(values, column, [fraction])[0]
