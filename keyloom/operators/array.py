"""Addressed arrays: cells 0 to size - 1 with a default, kept sparsely; the first of several writes to a cell wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import salted_hash


class AddressedArray:
    """df: addr (long) and value, at most one row an address; what is missing has the default."""

    def __init__(self, df: DataFrame, size: int, default=None) -> None:
        self.df, self.size, self.default = df.select("addr", "value"), size, default

    @classmethod
    def filled(cls, spark: SparkSession, size: int, default, value_type: str = "bigint") -> AddressedArray:
        return cls(spark.createDataFrame([], f"addr bigint, value {value_type}"), size, default)

    @classmethod
    def from_records(cls, df: DataFrame, size: int, order: str, value: str = "value") -> AddressedArray:
        """The i-th record, by order, goes to address i; there must be exactly `size` of them."""
        from .order import position

        if (n := df.count()) != size:
            raise ValueError(f"{n} records for {size} cells")
        return cls(position(df.select(order, F.col(value).alias("value")), order, "addr", start=0), size)

    def _checked(self, requests: DataFrame) -> DataFrame:
        inside = F.col("addr").between(0, self.size - 1)
        error = F.raise_error(F.concat(F.lit("no such address: "), F.coalesce(F.col("addr").cast("string"), F.lit("null"))))
        return requests.withColumn("addr", F.when(inside, F.col("addr")).otherwise(error))

    def dense(self) -> DataFrame:
        """addr, value of all cells."""
        return self.read_batch(self.df.sparkSession.range(self.size).select(F.col("id").alias("addr")))

    def read_batch(self, requests: DataFrame) -> DataFrame:
        """requests (with addr) plus value."""
        own = self.df.withColumn("_set", F.lit(True))
        out = self._checked(requests).join(own, "addr", "left")
        return out.withColumn("value", F.when(F.col("_set"), F.col("value")).otherwise(F.lit(self.default))).drop("_set")

    def access_batch(self, requests: DataFrame, order: str, new: Callable[[Column], Column], keep: Column | None = None) -> tuple[AddressedArray, DataFrame]:
        """Read, modify, write: requests plus value as it was, and the array after.

        Every request sees the old value; new(old) of a cell's first request is stored (so increments count once).
        keep false: the request only reads."""
        got = self.read_batch(requests)
        written = got.where(F.coalesce(keep, F.lit(False))) if keep is not None else got
        return self._store(written.withColumn("_new", new(F.col("value"))), order), got

    def transform_batch(self, requests: DataFrame, order: str, f: Callable[[DataFrame], DataFrame]) -> tuple[AddressedArray, DataFrame]:
        """access_batch with a callback for the whole batch: f gets the requests with their values and gives rows with addr,
        the order column and new, and leaves out what should not be written. f may use mapInPandas."""
        got = self.read_batch(requests)
        return self._store(f(got).select("addr", order, F.col("new").alias("_new")), order), got

    def write_batch(self, requests: DataFrame, order: str, keep: Column | None = None) -> AddressedArray:
        """requests (addr, value): the first write of each cell counts."""
        if keep is not None:
            requests = requests.where(F.coalesce(keep, F.lit(False)))
        return self._store(self._checked(requests).withColumn("_new", F.col("value")), order)

    def update_or_remove(self, requests: DataFrame, order: str, new: Callable[[Column], Column], stays: Callable[[Column], Column]) -> AddressedArray:
        """Cells whose first request leaves a value that doesn't stay are emptied to the default."""
        after, _ = self.access_batch(requests, order, new)
        return AddressedArray(after.df.join(requests.select("addr"), "addr", "left_semi").where(stays(F.col("value"))).unionByName(after.df.join(requests.select("addr"), "addr", "left_anti")), self.size, self.default)

    def _store(self, writes: DataFrame, order: str) -> AddressedArray:
        first = writes.groupBy("addr").agg(F.min_by(F.struct(F.col("_new").alias("v")), order).alias("_w"))
        both = self.df.join(first, "addr", "full_outer")
        return AddressedArray(both.select("addr", F.when(F.col("_w").isNotNull(), F.col("_w.v")).otherwise(F.col("value")).alias("value")), self.size, self.default)


def positions(array: AddressedArray, salt: str = "") -> DataFrame:
    """uid, position: a place for each cell of an array, spread over all cells by a salted hash: what a loader hands on
    to the index above it."""
    cells = array.df.sparkSession.range(array.size).select(F.col("id").alias("uid"))
    return cells.withColumn("position", F.pmod(salted_hash(F.col("uid"), salt), F.lit(array.size)))


def load_histogram(df: DataFrame, bucket: str) -> DataFrame:
    """load, buckets: how many buckets hold how many rows. Counted before the shuffle, so a full bucket is no hot task."""
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("load")).groupBy("load").agg(F.count(F.lit(1)).alias("buckets"))


def split_address(addr: Column, chunk: int = 8, fan_out: int = 8, levels: int = 3) -> list[Column]:
    """Slot in the leaf chunk, then the slot at each level above, then what is left."""
    out, rest = [(addr % chunk).alias("slot")], (addr - addr % chunk) / chunk
    rest = rest.cast("long")
    for i in range(1, levels):
        out.append((rest % fan_out).alias(f"slot{i}"))
        rest = ((rest - rest % fan_out) / fan_out).cast("long")
    return [*out, rest.alias("rest")]
