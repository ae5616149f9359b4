"""Keyed tables: finite maps from keys to values as immutable snapshots.

Batch operations are joins: find is a left join, insert a full join, update a left join, erase an anti join. Requests carry
an order column, as rows have no order of their own. Flags always tell what held before the batch, so copies of a key
agree. Null keys stand for dummies: they match nothing and are never stored. Nothing runs before an action, except
the checks of a strict load.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class DuplicateKeyError(ValueError):
    """A strict load met a key twice."""


class CapacityError(ValueError):
    """More rows than the declared capacity."""


#: A batch of less than this part of a table is a small one.
SMALL_PART = 8


def size_in_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _real(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(keys))


class KeyedTable:
    """df has one row for each key; keys and values name its columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None, capacity: int | None = None) -> None:
        self.keys = list(keys)
        self.values = list(values) if values is not None else [c for c in df.columns if c not in self.keys]
        if missing := [c for c in (*self.keys, *self.values) if c not in df.columns]:
            raise ValueError(f"no such columns: {missing}")
        self.df, self.capacity = df.select(*self.keys, *self.values), capacity

    # ---- loading

    @classmethod
    def empty(cls, spark: SparkSession, schema: StructType | str, keys: Sequence[str], capacity: int | None = None) -> KeyedTable:
        return cls(spark.createDataFrame([], schema), keys, capacity=capacity)

    @classmethod
    def load(cls, df: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None, *, duplicates: str = "error", order: str | None = None, capacity: int | None = None, is_dummy: Column | None = None) -> KeyedTable:
        """Bulk load. duplicates: "error", or "last" (the row with the greatest order wins). Dummies are left out."""
        values = list(values) if values is not None else [c for c in df.columns if c not in (*keys, order)]
        if is_dummy is not None:
            df = df.where(~F.coalesce(is_dummy, F.lit(False)))
        df = _real(df, keys)
        if duplicates == "last":
            if order is None:
                raise ValueError("the last row is asked for, but no order is given")
            df = winners(df, keys, values, order)
        elif duplicates != "error":
            raise ValueError(f"duplicates={duplicates!r}")
        elif found := duplicate_keys(df, keys).head(1):
            raise DuplicateKeyError(f"twice or more: {found[0].asDict()}")
        out = cls(df, keys, values, capacity)
        if capacity is not None and (n := out.count()) > capacity:
            raise CapacityError(f"{n} rows for {capacity}")
        return out

    @classmethod
    def from_slots(cls, df: DataFrame, keys: Sequence[str], values: Sequence[str], valid: str, is_dummy: str) -> KeyedTable:
        """A copy of raw slots: those that are valid and no dummies."""
        return cls(df.where(F.col(valid) & ~F.col(is_dummy)), keys, values)

    @staticmethod
    def builder(keys: Sequence[str], capacity: int | None = None) -> TableBuilder:
        return TableBuilder(keys, capacity)

    def _with(self, df: DataFrame) -> KeyedTable:
        return KeyedTable(df, self.keys, self.values, self.capacity)

    # ---- batches

    def _met(self, batch: DataFrame, flag: str, values: dict[str, str], distinct_first: bool | None = None) -> DataFrame:
        """batch with values (as named) of its keys and the flag. Columns of batch with those names give way.

        distinct_first: only rows whose key is in the batch go on to the join with it. By default if the batch is a small
        part of the table, by the optimizer's sizes; Spark then sends its keys to the table, if they are few enough."""
        own = self.df.select(*self.keys, *values)
        if SMALL_PART * size_in_bytes(batch) < size_in_bytes(own) if distinct_first is None else distinct_first:
            own = own.join(_real(batch, self.keys).select(*self.keys).distinct(), self.keys)
        own = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], F.lit(True).alias("_f"))
        on = [batch[k] == F.col(f"_k{i}") for i, k in enumerate(self.keys)]
        keep = [batch[c] for c in batch.columns if c != flag and c not in values.values()]
        return batch.join(own, on, "left").select(*keep, *[F.col(f"_v{i}").alias(n) for i, n in enumerate(values.values())], F.coalesce("_f", F.lit(False)).alias(flag))

    def find_batch(self, probe: DataFrame, *, default: dict | None = None, distinct_first: bool | None = None) -> DataFrame:
        """probe (with the key columns) plus the values and found. A miss has null values, or those of `default`.

        distinct_first probes each key once and fans the results out: worth it for small probes of large tables, which
        is the default, and if keys repeat a lot and values are wide. Columns of probe that are named like a value, or found, are replaced."""
        out = self._met(probe, "found", {v: v for v in self.values}, distinct_first)
        for name, value in (default or {}).items():
            out = out.withColumn(name, F.when(F.col("found"), F.col(name)).otherwise(F.lit(value)))
        return out

    def existed(self, batch: DataFrame, flag: str = "existed") -> DataFrame:
        """batch plus existed: whether its key was there before."""
        return self._met(batch, flag, {})

    def insert_batch(self, batch: DataFrame, order: str) -> tuple[KeyedTable, DataFrame]:
        """Upsert; of several rows of a key the one with the greatest order wins. The new table, and batch with existed."""
        new = winners(_real(batch, self.keys), self.keys, self.values, order)
        return self._with(self._merged(new, "full_outer")), self.existed(batch)

    def _merged(self, new: DataFrame, how: str) -> DataFrame:
        both = self.df.alias("m").join(new.withColumn("_new", F.lit(True)).alias("n"), self.keys, how)
        return both.select(*self.keys, *[F.when(F.col("_new"), F.col(f"n.{v}")).otherwise(F.col(f"m.{v}")).alias(v) for v in self.values])

    def swap_batch(self, batch: DataFrame, order: str) -> tuple[KeyedTable, DataFrame]:
        """insert_batch whose flags also have the values before, as old_*."""
        table, _ = self.insert_batch(batch, order)
        return table, self._met(batch, "existed", {v: f"old_{v}" for v in self.values})

    def update_batch(self, batch: DataFrame, order: str) -> tuple[KeyedTable, DataFrame]:
        """New values for keys that are there; others are ignored, never inserted. Flags: found."""
        new = winners(_real(batch, self.keys), self.keys, self.values, order)
        return self._with(self._merged(new, "left")), self.existed(batch, "found")

    def erase_batch(self, batch: DataFrame) -> tuple[KeyedTable, DataFrame]:
        return self._with(self.df.join(batch.select(*self.keys), self.keys, "left_anti")), self.existed(batch)

    # ---- single keys

    def _row(self, key: dict, value: dict | None = None) -> DataFrame:
        names = self.keys + (self.values if value is not None else [])
        kinds = StructType([self.df.schema[n] for n in names])
        one = self.df.sparkSession.createDataFrame([tuple({**key, **(value or {})}[n] for n in names)], kinds)
        return one.withColumn("_ord", F.lit(0))

    def insert(self, key: dict, value: dict) -> tuple[KeyedTable, DataFrame]:
        return self.insert_batch(self._row(key, value), "_ord")

    def update(self, key: dict, value: dict) -> tuple[KeyedTable, DataFrame]:
        return self.update_batch(self._row(key, value), "_ord")

    def find(self, key: dict) -> DataFrame:
        return self.find_batch(self._row(key).drop("_ord"))

    def erase(self, key: dict) -> tuple[KeyedTable, DataFrame]:
        return self.erase_batch(self._row(key).drop("_ord"))

    # ---- facts

    def count(self) -> int:
        return self.df.count()

    def size_in_bytes(self) -> int:
        """What the optimizer takes the table's size to be."""
        return size_in_bytes(self.df)

    def checkpointed(self) -> KeyedTable:
        """The same table with its lineage cut in the session's checkpoint folder: for long runs of batches."""
        return self._with(self.df.checkpoint())


def winners(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """One row for each key: that with the greatest order. Combined before the shuffle, so a hot key is no hot task."""
    best = F.max_by(F.struct(*values), order) if values else F.max(order)
    out = df.groupBy(*keys).agg(best.alias("_w"))
    return out.select(*keys, *[F.col(f"_w.{v}").alias(v) for v in values])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class TableBuilder:
    """Gathers batches; finalize() loads them, later batches last."""

    def __init__(self, keys: Sequence[str], capacity: int | None = None) -> None:
        self.keys, self.capacity, self.parts, self.done = list(keys), capacity, [], False

    def add(self, batch: DataFrame, order: str | None = None) -> TableBuilder:
        """order: a column that ranks the rows of this batch; without it the batch should not repeat a key."""
        if self.done:
            raise RuntimeError("finalized already")
        rank = F.struct(F.lit(len(self.parts)).alias("batch"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("row"))
        own = batch.withColumn("_ord", rank)
        self.parts.append(own.drop(order) if order else own)
        return self

    def finalize(self, duplicates: str = "last") -> KeyedTable:
        if self.done or not self.parts:
            raise RuntimeError("finalized already, or nothing was added")
        self.done = True
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return KeyedTable.load(out, self.keys, duplicates=duplicates, order="_ord", capacity=self.capacity)
