"""Moving rows: compaction, distribution, interleaving, buckets, shards, padding and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.folders import checkpoint_dir
from .order import Running, position, position_within, running


class BucketOverflow(ValueError):
    """A bucket holds more rows than it may."""


def compact(df: DataFrame, order: str, mark: Column) -> DataFrame:
    """The marked rows with their place pos among them, from 1, in order."""
    return position(df.where(mark), order, "pos")


def prefix_sum(df: DataFrame, order: str, mark: Column, name: str = "before") -> DataFrame:
    """df with the number of marked rows before each row."""
    return running(df, order, {name: Running("sum", mark.cast("long"))})


def distribute(items: DataFrame, item_order: str, slots: DataFrame, slot_order: str, mark: Column) -> DataFrame:
    """slots, each marked one with the columns of the item of the same rank: the inverse of compact. The others get nulls."""
    ranked = position(items, item_order, "_rank")
    at = prefix_sum(slots, slot_order, mark, "_before").withColumn("_rank", F.when(mark, F.col("_before") + 1))
    return at.join(ranked, "_rank", "left").drop("_rank", "_before")


def interleave(df: DataFrame, mark: str, order: str) -> DataFrame:
    """df with round and pos: rows in the order of pos cycle through the marks, as far as each mark has rows."""
    ranked = position_within(df, mark, order, "round")
    size = ranked.groupBy("round").agg(F.count(F.lit(1)).alias("_n"))
    base = running(size, "round", {"_base": Running("sum", F.col("_n"))}).select("round", "_base")
    within = F.row_number().over(W.partitionBy("round").orderBy(mark))
    return ranked.join(base, "round").withColumn("pos", (F.col("_base") + within).cast("long")).drop("_base")


def by_tag(tag: Column, ways: int) -> tuple[Column, Column]:
    """Bucket and what is left of the tag for the next level."""
    bucket = F.pmod(tag, F.lit(ways))
    return bucket, ((tag - bucket) / ways).cast("long")


def by_pivots(value: Column, pivots: Sequence) -> Column:
    """Number of pivots below the value."""
    return sum((F.when(value > p, 1).otherwise(0) for p in pivots), F.lit(0)).cast("int")


def check_capacity(df: DataFrame, bucket: str, capacity: int) -> DataFrame:
    """df, if no bucket has more rows than capacity; else an error."""
    if over := df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > capacity).head(1):
        raise BucketOverflow(f"bucket {over[0][0]} has {over[0].n} rows, more than {capacity}")
    return df


def split_two_ways(df: DataFrame, order: str, right: Column, capacity: int) -> DataFrame:
    """df with side (0 or 1) and slot (from 1), each side padded with dummies (null rows) to its capacity.

    An error if a side has more rows than that."""
    sides = check_capacity(df.withColumn("side", right.cast("int")), "side", capacity)
    return pad(sides, "side", order, 2, capacity)


def pad(df: DataFrame, shard: str, order: str, shards: int, width: int) -> DataFrame:
    """Exactly `width` slots for each of the shards 0 to shards - 1: shard, slot (from 1), and the rows' columns, null in
    slots without a row. Every shard looks equally full, whatever the data. order: a numeric column."""
    ranked = position_within(df, shard, order, "slot").withColumn(shard, F.col(shard).cast("long"))
    grid = df.sparkSession.range(shards * width).select((F.col("id") % shards).alias(shard), (F.expr(f"id div {shards}") + 1).alias("slot"))
    return grid.join(ranked, [shard, "slot"], "left")


def shard_loads(df: DataFrame, shard: str, key: str) -> DataFrame:
    """shard, keys: distinct keys of each shard."""
    return df.groupBy(shard).agg(F.count_distinct(key).alias("keys"))


def pad_shards(df: DataFrame, shard: str, key: str, shards: int, bound: int = 0) -> DataFrame:
    """Distinct keys, every shard padded to one width: the bound, or the fullest shard if that is wider."""
    keys = df.select(shard, key).where(F.col(key).isNotNull()).distinct()
    fullest = keys.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    if isinstance(keys.schema[key].dataType, NumericType):
        return pad(keys, shard, key, shards, max(bound, fullest))
    return pad(keys.withColumn("_hash", F.xxhash64(key)), shard, "_hash", shards, max(bound, fullest)).drop("_hash")


def propagate(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with value replaced by that of the key's first row, and is_first. Order values of a key are distinct.

    First rows are combined before the shuffle; the join has nothing above it that needs a key's rows together."""
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(order).alias("o")), order).alias("_f"))
    own = df.join(first, F.col(key).eqNullSafe(F.col("_k")))
    return own.withColumn("is_first", F.col(order) == F.col("_f.o")).withColumn(value, F.col("_f.v")).drop("_k", "_f")


def route(df: DataFrame, shard: str, shards: int, capacity: int | None = None) -> DataFrame:
    """Rows of a shard together: one exchange. With a capacity, an error if a shard has more rows."""
    if capacity is not None:
        df = check_capacity(df, shard, capacity)
    return df.repartition(shards, shard)


def sorted_rank(df: DataFrame, *columns: str, name: str = "rank") -> DataFrame:
    """df, range-partitioned and sorted by columns, with each row's rank: a total order if the columns are unique.

    Ranks come from row counts of the sorted partitions, which are written out so that they stay as they are."""
    spark = df.sparkSession
    parts = df.orderBy(*columns).withColumn("_id", F.monotonically_increasing_id())
    parts = parts.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    parts = parts.checkpoint()
    base = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return parts.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")


def shuffled(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())


def choose(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def swapped(condition: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """a and b, exchanged where the condition holds."""
    return choose(condition, b, a), choose(condition, a, b)
