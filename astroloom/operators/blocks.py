"""Ordered work on groups of any size. One group may hold most of a table, so no group is sorted or kept in one task: rows
are cut into ranges of their order, written once, and ranges of a group meet only in one row each, which says what the
ranges before it add up to.

``by`` columns may be null and are told apart as ``<=>`` does; ``order`` columns that leave ties put them in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rows of a group that are sorted together for windows over neighbours.
BLOCK = 65_536
#: Rows from which on a group's quantiles are found in ranges.
HOT = 1_000_000


def beside(rows: DataFrame, found: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Rows with what was found for their group, null groups too; ``found`` has a row for each group."""
    found = found.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    return rows.join(found, same, how).drop(*[f"_k{i}" for i in range(len(by))])


def scanned(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds, in each group's order and including the row itself, running sums and the last value that is not null.

    The row's own number breaks ties of the order, so a run of equal keys is spread over ranges as well."""
    sums, lasts = sums or {}, lasts or {}
    keys = [*by, *order]
    rows = rows.withColumns({f"_v_{k}": v for k, v in {**sums, **lasts}.items()} | {"_scan_row": F.monotonically_increasing_id()})
    ranged = stored(rows.repartitionByRange(*keys, "_scan_row").sortWithinPartitions(*keys, "_scan_row").withColumn("_scan_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_scan_p", F.shiftrightunsigned("_scan_at", 33))
    inside = W.partitionBy("_scan_p", *by).orderBy("_scan_at").rowsBetween(W.unboundedPreceding, 0)
    here = {k: F.sum(f"_v_{k}").over(inside) for k in sums} | {k: F.last(f"_v_{k}", ignorenulls=True).over(inside) for k in lasts}
    # What each range holds of a group, then what the ranges before it hold: of groups that span ranges alone, so no more
    # rows than ranges.
    held = [F.sum(f"_v_{k}").alias(f"_b_{k}") for k in sums] + [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col("_scan_at"))).alias(f"_b_{k}") for k in lasts]
    earlier = W.partitionBy(*by).orderBy("_scan_p").rowsBetween(W.unboundedPreceding, -1)
    before = {f"_b_{k}": F.sum(f"_b_{k}").over(earlier) for k in sums} | {f"_b_{k}": F.last(f"_b_{k}", ignorenulls=True).over(earlier) for k in lasts}
    carried = ranged.groupBy("_scan_p", *by).agg(*held, F.lit(1).alias("_n")).withColumns({**before, "_n": F.sum("_n").over(earlier)}).filter("_n > 0")
    carried = F.broadcast(carried.select("_scan_p", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *before))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], ranged["_scan_p"] == carried["_scan_p"])
    joined = ranged.withColumns(here).join(carried, same, "left").drop(carried["_scan_p"])
    whole = {k: F.when(F.col(k).isNull() & F.col(f"_b_{k}").isNull(), None).otherwise(F.coalesce(k, F.lit(0)) + F.coalesce(f"_b_{k}", F.lit(0))) for k in sums}
    whole |= {k: F.coalesce(k, f"_b_{k}") for k in lasts}
    return joined.withColumns(whole).drop(*[f"_v_{k}" for k in whole], *[f"_b_{k}" for k in whole], *[f"_k{i}" for i in range(len(by))], "_scan_row", "_scan_at", "_scan_p")


def placed(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place in its group's order, from 0."""
    return scanned(rows, by, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def windowed(rows: DataFrame, by: list[str], order: list[str], before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], size: int | None = None) -> DataFrame:
    """Adds columns over each row and up to ``before`` and ``after`` neighbours of its group.

    Groups are cut into blocks of ``size`` places, and rows near an edge are copied into the block beyond it; ``columns``
    gets the ordered window of a block and may reach no farther than the neighbours it asked for."""
    size = max(size or BLOCK, before, after, 1)
    rows = placed(rows, by, order, "_place")
    at, block = F.pmod("_place", F.lit(size)), F.floor(F.col("_place") / size)
    copies = F.array(F.lit(0), F.when(at >= size - before, 1), F.when((at < after) & (block > 0), -1))
    rows = rows.withColumn("_to", F.explode(F.array_compact(copies))).withColumn("_block", block + F.col("_to"))
    return rows.withColumns(columns(W.partitionBy(*by, "_block").orderBy("_place"))).filter("_to = 0").drop("_place", "_to", "_block")


def spread_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles with linear interpolation, nulls left out. Equal values are counted
    before they are ordered, and a group's values are ordered in ranges, so no group's values meet in one task."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    ranked = scanned(counted, by, ["_x"], {"_upto": F.col("_n")})
    # Joined back to each value rather than windowed: a group's total is one row.
    total = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = beside(ranked, total, by, "inner") if by else ranked.crossJoin(F.broadcast(total))  # a single row
    held = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    out = {}
    for name, share in shares.items():
        at = (F.col("_all") - 1) * F.lit(float(share))
        low, high = (F.max(F.when(held(f(at)), F.col("_x"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out[name] = F.when(part == 0, low).otherwise(low + (high - low) * part)
    return ranked.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], hot: int | None = None) -> DataFrame:
    """The same rows; groups of up to ``hot`` rows are ordered in one buffer each, larger ones in ranges."""
    plain = lambda df: df.filter(F.col(value).isNotNull()).groupBy(*by).agg(*[F.percentile(value, F.lit(float(q))).alias(k) for k, q in shares.items()])
    if not by:
        return spread_quantiles(rows, by, value, shares)
    large = rows.groupBy(*by).agg(F.count(value).alias("_n")).filter(F.col("_n") > (hot or HOT)).select(*by)
    if large.isEmpty():
        return plain(rows)
    large = stored(large)  # it has no more rows than the table has over ``hot``
    return plain(beside(rows, large, by, "left_anti")).unionByName(spread_quantiles(beside(rows, large, by, "left_semi"), by, value, shares))
