"""Running values over a whole table without one task that sees all rows.

A window without partitions would put every row into one task. Here rows fall into buckets by ranges of the ordering
column (bounds from quantiles), each bucket is summed up to one small row, what the buckets before (or after) give is
added up over those rows, and a window within each bucket does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """A running value: kind (count, sum, min or max) of value over the rows before a row, or with after=True the rows
    after it. The row itself doesn't count."""

    kind: str
    value: Column
    after: bool = False


_AGG = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_TOTAL = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def buckets(df: DataFrame, order: str, n: int | None = None) -> Column:
    """Bucket of a row: ranges of a numeric column, about equally full."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.lit([int(x) for x in bounds]), lambda x: x <= F.col(order)))


def running(df: DataFrame, order: str, values: dict[str, Running], n: int | None = None) -> DataFrame:
    """df with the running values. order: a column of distinct, non-null integers.

    Sums and counts are 0 where there is no row, minima and maxima null."""
    own = df.withColumn("_bucket", buckets(df, order, n))
    parts = own.groupBy("_bucket").agg(*[_AGG[v.kind](v.value).alias(f"_p_{name}") for name, v in values.items()])
    # One row for each bucket, so both the window over them and the broadcast have a fixed size.
    before, after = (W.orderBy("_bucket").rowsBetween(*x) for x in ((W.unboundedPreceding, -1), (1, W.unboundedFollowing)))
    carried = parts.select("_bucket", *[_TOTAL[v.kind](f"_p_{name}").over(after if v.after else before).alias(f"_c_{name}") for name, v in values.items()])
    own = own.join(F.broadcast(carried), "_bucket")
    # Rows after a row are rows before it in reverse order: a growing frame is linear, a shrinking one quadratic.
    forth, back = (W.partitionBy("_bucket").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col(order).asc(), F.col(order).desc()))
    out = {}
    for name, v in values.items():
        here, there = _AGG[v.kind](v.value).over(back if v.after else forth), F.col(f"_c_{name}")
        if v.kind in ("count", "sum"):
            out[name] = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        else:
            out[name] = (F.least if v.kind == "min" else F.greatest)(here, there)
    return own.withColumns(out).drop("_bucket", *[f"_c_{name}" for name in values])


def position(df: DataFrame, order: str, name: str = "pos", start: int = 1) -> DataFrame:
    """df with each row's place in the order, from `start`."""
    return running(df, order, {name: Running("count", F.lit(1))}).withColumn(name, F.col(name) + start)


def position_within(df: DataFrame, by: str, order: str, name: str = "pos", start: int = 1) -> DataFrame:
    """df with each row's place among the rows of its group, from `start`. A group of any size is many tasks' work."""
    own = df.withColumn("_bucket", buckets(df, order))
    before = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # One row for each group and bucket.
    parts = own.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = own.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b")))
    here = F.row_number().over(W.partitionBy(by, "_bucket").orderBy(order))
    return own.withColumn(name, (F.col("_base") + here + (start - 1)).cast("long")).drop("_bucket", "_by", "_b", "_base")
