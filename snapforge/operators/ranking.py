"""Running sums, ranks and exact percentiles over all rows without sending them to one task.

A window without a partition puts every row in one task. Here a column's approximate quantiles, a bounded list, cut its values into
ranges; each range is summed by itself, and the sums of the ranges before it, one row each, are added.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ranges(rows: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """rows with __range, an order-keeping number of the range that the double `by` lies in; equal values lie in one range."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(by, shares, 100 * parts)).first()[0] if shares else None  # parts - 1 numbers
    inner = sorted({float(c) for c in cuts or [] if c is not None and abs(c) != float("inf") and c == c}) or [0.0]
    return Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol=by, outputCol="__range", handleInvalid="keep").transform(rows).withColumn("__range", F.col("__range").cast("int"))


def running(rows: DataFrame, by: str, sums: dict[str, str], within: list[str] | None = None, ties: list[str] | None = None, descending: bool = False, parts: int | None = None) -> DataFrame:
    """rows with, for each name, the sum of a column over the rows up to this one by the double `by` (no nulls), then by the columns
    `ties`; within: apart for each of their values. Rows that tie in all are in an order of no consequence only if they are equal."""
    within, ties = within or [], ties or []
    cut = ranges(rows, by, parts)
    keys = [*within, "__range"]
    each = cut.groupBy(*keys).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    order = F.desc("__range") if descending else F.asc("__range")
    before = W.Window.partitionBy(*within).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each range
    offsets = each.select(*[F.col(k).alias(f"__o_{k}") for k in keys], *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    own = W.Window.partitionBy(*keys).orderBy(F.desc(by) if descending else F.asc(by), *ties).rowsBetween(W.Window.unboundedPreceding, 0)
    summed = cut.withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys]
    joined = summed.join(offsets if within else F.broadcast(offsets), same)  # without `within` one row for each range
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).select(*rows.columns, *sums)


def numbered(rows: DataFrame, by: str, ties: list[str], name: str = "rn", within: list[str] | None = None, descending: bool = False) -> DataFrame:
    """rows with their number from 1 on, by `by` and then the columns `ties`."""
    return running(rows.withColumn("__one", F.lit(1).cast("long")), by, {name: "__one"}, within, ties, descending).drop("__one")


def average_ranks(rows: DataFrame, by: str, name: str, within: list[str] | None = None) -> DataFrame:
    """rows whose `by` isn't null, with the mean rank of equal values. Values are counted first, so a value that a third of all rows
    share is one row."""
    within = within or []
    values = rows.where(F.col(by).isNotNull()).groupBy(*within, F.col(by).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(values, "__v", {"__upto": "__n"}, within)
    ranked = upto.select(*[F.col(k).alias(f"__k_{k}") for k in within], "__v", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return rows.join(ranked, [F.col(by).cast("double") == F.col("__v"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in within]]).select(*rows.columns, name)


def percentiles(rows: DataFrame, by: str, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, a column for each share): the exact percentiles with linear interpolation, of the values that aren't null. Distinct values
    are counted and their counts summed by range, so no task holds all values of a key."""
    values = rows.where(F.col(by).isNotNull()).groupBy(*keys, F.col(by).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(values, "__v", {"__upto": "__n"}, keys)
    total = values.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    same = [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys]
    with_total = upto.join(total.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__total"), same) if keys else upto.crossJoin(F.broadcast(total))  # one row
    at = lambda p: F.col("__total").cast("double").__sub__(1) * p
    held = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    parts = {}
    for n, p in shares.items():
        parts |= {f"__lo_{n}": held(F.floor(at(p))), f"__hi_{n}": held(F.ceil(at(p))), f"__at_{n}": F.max(at(p) - F.floor(at(p)))}
    found = with_total.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])
    between = lambda n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__at_{n}")
    return found.select(*keys, *[between(n).alias(n) for n in shares])


def tiles(rows: DataFrame, by: str, ties: list[str], n: int, name: str) -> DataFrame:
    """rows with the number of their tile of n, as ntile: the first ones hold a row more where n doesn't divide the rows."""
    total = rows.count()
    size, more = divmod(total, n)
    rn = F.col("__rn")
    whole = F.lit(more * (size + 1))
    tile: Column = F.when(rn <= whole, F.floor((rn - 1) / (size + 1)) + 1).otherwise(more + F.floor((rn - 1 - whole) / max(size, 1)) + 1)
    return numbered(rows, by, ties, "__rn").withColumn(name, tile.cast("int")).drop("__rn")
