"""Replay of operation logs: every operation sees the effect of all earlier ones.

Columns: order, key, op (I insert or overwrite, U update only if present, E erase, anything else find), value. A key's log is
cut at ranges of the order column. Each part is summed up (its last insert or erase, and the value that it leaves), what
is left before a part follows from the sums of those before it, and window passes within the part do the rest. So a
key that has a third of all operations is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import buckets


def replay(log: DataFrame, order: str = "ord", key: str = "key", op: str = "op", value: str = "value") -> DataFrame:
    """log plus found and found_value: what the operation met. Nothing but finds needs them, yet all have them."""
    own = log.withColumn("_part", buckets(log, order)).withColumn("_v", F.struct(F.col(value).alias("v")))
    ends, writes = F.col(op).isin("I", "E"), F.col(op).isin("I", "U")
    # An erase that comes last leaves nothing; else the last insert or update of a part is what it leaves, if anything.
    last = lambda cond, what: F.max_by(F.when(cond, what), F.when(cond, F.col(order)))
    parts = own.groupBy(key, "_part").agg(last(ends, F.col(op)).alias("_e"), last(writes, F.col("_v")).alias("_w"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.last("_e", ignorenulls=True).over(before).alias("_before"), F.last("_w", ignorenulls=True).over(before).alias("_left"))
    own = own.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    here = W.partitionBy(key, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = own.withColumns(
        {
            "_last": F.coalesce(F.last(F.when(ends, F.col(op)), ignorenulls=True).over(here), F.col("_before")),
            "_era": F.coalesce(F.sum(F.when(F.col(op) == "E", 1).otherwise(0)).over(here), F.lit(0)),
        }
    )
    found = F.coalesce(F.col("_last") == "I", F.lit(False))
    since = W.partitionBy(key, "_part", "_era").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    counts = F.when((F.col(op) == "I") | ((F.col(op) == "U") & found), F.col("_v"))
    got = F.coalesce(F.last(counts, ignorenulls=True).over(since), F.col("_left"))
    return seen.withColumn("found", found).withColumn("found_value", F.when(F.col("found"), got["v"])).drop("_last", "_era", "_part", "_p", "_key", "_v", "_before", "_left")


def final_state(log: DataFrame, order: str = "ord", key: str = "key", op: str = "op", value: str = "value") -> DataFrame:
    """key, value of the keys that are present after the whole log.

    Aggregates only: after a key's last erase its first insert starts it, and the last insert, or later update, wins."""
    erased = log.where(F.col(op) == "E").groupBy(key).agg(F.max(order).alias("_e"))
    alive = log.where(F.col(op).isin("I", "U")).join(erased, key, "left").where(F.col("_e").isNull() | (F.col(order) > F.col("_e")))
    first = F.min(F.when(F.col(op) == "I", F.col(order))).alias("_first")
    # The winner of all rows is the last one, unless no insert came before it; then nothing was present.
    best = alive.groupBy(key).agg(first, F.max(order).alias("_last"), F.max_by(F.struct(F.col(value).alias("v")), order).alias("_w"))
    return best.where("_first is not null").select(key, F.col("_w.v").alias(value))
