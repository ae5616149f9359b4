"""Keyed tables on disk: a base in folders by shard of the key, and the batches since then as small runs on top.

A batch of changes is one run, written by itself; nothing of the base is rewritten, so its cost follows the batch. Reads
take only the shards that the probe's keys are in, of the base and, by pushed-down filters, of the runs; the last run
that has a key decides. compact() folds the runs into the base, again only in shards that have any.

What is current is named by one pointer that moves atomically, together with the caller's entries and further small
tables: a change is seen whole or not at all, and a crash leaves what was there before. Files never change.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..sources.folders import Pointer, delete, names
from .table import KeyedTable, size_in_bytes, winners

#: Shards of a table unless it says otherwise, and runs on top of its base at which compact_if_due() folds them in.
SHARDS, MOST_RUNS = 16, 12
#: Bytes of a batch for each shard from which on it isn't asked which shards it touches.
ALL_SHARDS, UNKNOWN = 4096, 1 << 62


class StoredTable:
    """Opens the table below root. Keys and values of a run are as in the base; null keys are dummies, never stored."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pointer = spark, root.rstrip("/"), Pointer(spark, root)
        if (state := self.pointer.read()) is None:
            raise FileNotFoundError(root)
        self.state = state
        self.keys, self.values = state["keys"], state["values"]
        self.schema = StructType.fromJson(state["schema"])

    # ---- loading

    @staticmethod
    def create(root: str, df: DataFrame, keys: Sequence[str], *, duplicates: str = "error", order: str | None = None, shards: int = SHARDS, tables: dict[str, DataFrame] | None = None, **entries) -> StoredTable:
        """Loads df as KeyedTable.load does, and writes it by shard."""
        spark, root = df.sparkSession, root.rstrip("/")
        own = KeyedTable.load(df, keys, duplicates=duplicates, order=order)
        _by_shard(own.df, own.keys, shards).write.partitionBy("_shard").parquet(f"{root}/run-0")
        schema = StructType([StructField(f.name, f.dataType, True) for f in own.df.schema])
        state = {"version": 0, "keys": own.keys, "values": own.values, "shards": shards, "schema": schema.jsonValue(), "base": dict.fromkeys(_shards_in(spark, f"{root}/run-0"), "run-0"), "runs": [], "tables": {}, "entries": entries}
        for name, table in (tables or {}).items():
            table.write.parquet(f"{root}/{name}-0")
            state["tables"][name] = f"{name}-0"
        Pointer(spark, root).write(state)
        return StoredTable(spark, root)

    # ---- reading

    def entries(self) -> dict:
        return dict(self.state["entries"])

    def table(self, name: str) -> DataFrame:
        """A further table that was published with the last change."""
        return self.spark.read.parquet(f"{self.root}/{self.state['tables'][name]}")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.state["shards"])).cast("int")

    def _touched(self, df: DataFrame) -> list[int] | None:
        """Shards of a batch's keys: at most as many numbers as there are shards. None, for all of them, if the batch is
        so large that it will hardly leave one out."""
        if ALL_SHARDS * self.state["shards"] < size_in_bytes(df) < UNKNOWN:
            return None
        return sorted(r[0] for r in df.dropna("any", subset=self.keys).select(self._shard()).distinct().collect())

    def _runs(self, shards: Iterable[int] | None) -> DataFrame | None:
        """The last change of each key in the runs: keys, values, _gone."""
        parts = []
        for n, run in enumerate(self.state["runs"]):
            own = self.spark.read.schema(StructType([*self.schema, StructField("_gone", BooleanType()), StructField("_shard", IntegerType())])).parquet(f"{self.root}/{run}")
            parts.append((own if shards is None else own.where(F.col("_shard").isin(list(shards)))).drop("_shard").withColumn("_n", F.lit(n)))
        if not parts:
            return None
        return winners(reduce(DataFrame.unionByName, parts), self.keys, [*self.values, "_gone"], "_n")

    def rows(self, shards: Iterable[int] | None = None) -> DataFrame:
        """Keys and values, of all shards or of those given."""
        shards = None if shards is None else list(shards)
        paths = [f"{self.root}/{run}/_shard={k}" for k, run in self.state["base"].items() if shards is None or int(k) in shards]
        reader = self.spark.read.schema(self.schema)
        base = reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if (runs := self._runs(shards)) is None:
            return base
        return base.join(runs.select(*self.keys), self.keys, "left_anti").unionByName(runs.where("not _gone").drop("_gone"))

    def keyed(self, batch: DataFrame | None = None) -> KeyedTable:
        """The table as a KeyedTable, or only the shards that a batch's keys are in."""
        return KeyedTable(self.rows(None if batch is None else self._touched(batch)), self.keys, self.values)

    def find_batch(self, probe: DataFrame, **options) -> DataFrame:
        return self.keyed(probe).find_batch(probe, **options)

    def count(self) -> int:
        return self.rows().count()

    # ---- changes

    def commit(self, changes: DataFrame | None, tables: dict[str, DataFrame] | None = None, **entries) -> None:
        """changes: keys, values and _gone, one row a key. They, the tables and the entries become current at once."""
        state = {**self.state, "version": self.state["version"] + 1, "entries": {**self.state["entries"], **entries}}
        n = state["version"]
        if changes is not None:
            # Sorted by shard, so that filters on it skip row groups.
            own = changes.withColumn("_shard", self._shard()).select(*self.keys, *self.values, "_gone", "_shard")
            own.sortWithinPartitions("_shard", *self.keys).write.parquet(f"{self.root}/run-{n}")
            state["runs"] = [*state["runs"], f"run-{n}"]
        if tables:
            for name, table in tables.items():
                table.write.parquet(f"{self.root}/{name}-{n}")
            state["tables"] = {**state["tables"], **{name: f"{name}-{n}" for name in tables}}
        self.pointer.write(state)
        self.state = state

    def insert_batch(self, batch: DataFrame, order: str) -> DataFrame:
        """Upsert; of several rows of a key that with the greatest order wins. Gives batch with existed, as before the batch."""
        before = self.keyed(batch)
        self.commit(winners(batch.dropna("any", subset=self.keys), self.keys, self.values, order).withColumn("_gone", F.lit(False)))
        return before.existed(batch)

    def erase_batch(self, batch: DataFrame) -> DataFrame:
        """Erases the batch's keys; gives batch with existed."""
        before = self.keyed(batch)
        gone = batch.dropna("any", subset=self.keys).select(*self.keys).distinct()
        self.commit(gone.select(*self.keys, *[F.lit(None).cast(self.schema[v].dataType).alias(v) for v in self.values], F.lit(True).alias("_gone")))
        return before.existed(batch)

    def write_batch(self, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Puts (keys and values) and deletes (keys) at once. A key that is in both is put."""
        parts = []
        if puts is not None:
            parts.append(winners(puts.dropna("any", subset=self.keys).withColumn("_o", F.lit(0)), self.keys, self.values, "_o").withColumn("_gone", F.lit(False)))
        if deletes is not None:
            none = [F.lit(None).cast(self.schema[v].dataType).alias(v) for v in self.values]
            own = deletes.dropna("any", subset=self.keys).select(*self.keys).distinct().select(*self.keys, *none, F.lit(True).alias("_gone"))
            parts.append(own if puts is None else own.join(puts.select(*self.keys), self.keys, "left_anti"))
        self.commit(reduce(DataFrame.unionByName, parts))

    def compact(self) -> None:
        """Folds the runs into the base: new folders for the shards that have changes, the others stay as they are."""
        if not self.state["runs"]:
            return
        runs = [self.spark.read.parquet(f"{self.root}/{r}").select("_shard") for r in self.state["runs"]]
        touched = sorted(r[0] for r in reduce(DataFrame.unionByName, runs).distinct().collect())
        n = self.state["version"] + 1
        _by_shard(self.rows(touched), self.keys, self.state["shards"]).write.partitionBy("_shard").parquet(f"{self.root}/run-{n}")
        base = {k: r for k, r in self.state["base"].items() if int(k) not in touched} | dict.fromkeys(_shards_in(self.spark, f"{self.root}/run-{n}"), f"run-{n}")
        self.state = {**self.state, "version": n, "base": base, "runs": []}
        self.pointer.write(self.state)

    def compact_if_due(self, most: int = MOST_RUNS) -> None:
        if len(self.state["runs"]) >= most:
            self.compact()

    def vacuum(self) -> None:
        """Deletes what the pointer no longer names. Only when no reader still uses an older state."""
        used = {*self.state["base"].values(), *self.state["runs"], *self.state["tables"].values()}
        for name in names(self.spark, self.root):
            if "-" in name and not name.startswith(".") and name not in used:
                delete(self.spark, f"{self.root}/{name}")


def _by_shard(df: DataFrame, keys: Sequence[str], shards: int) -> DataFrame:
    return df.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")).repartition("_shard").sortWithinPartitions("_shard", *keys)


def _shards_in(spark: SparkSession, path: str) -> list[str]:
    return [x.removeprefix("_shard=") for x in names(spark, path) if x.startswith("_shard=")]


class KeyValueStore:
    """Text keys and values: single gets, puts and deletes, atomic batches, and iteration in the order of keys."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        try:
            self.own = StoredTable(spark, root)
        except FileNotFoundError:
            self.own = StoredTable.create(root, spark.createDataFrame([], "key string, value string"), ["key"])

    def _rows(self, pairs: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame(list(pairs), "key string, value string")

    def get(self, key: str, default: str | None = None) -> str | None:
        row = self.own.find_batch(self._rows([(key, None)]).select("key")).first()
        return row.value if row.found else default

    def get_many(self, keys: DataFrame) -> DataFrame:
        """keys (with key) plus value and found."""
        return self.own.find_batch(keys)

    def put(self, key: str, value: str) -> None:
        self.own.write_batch(self._rows([(key, value)]))

    def delete(self, key: str) -> bool:
        """Whether the key was there."""
        return bool(self.own.erase_batch(self._rows([(key, None)]).select("key")).first().existed)

    def write_batch(self, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        self.own.write_batch(puts, deletes)

    def items(self, start: str | None = None) -> DataFrame:
        """key, value in the order of keys, from `start` on."""
        rows = self.own.rows()
        return (rows if start is None else rows.where(F.col("key") >= start)).orderBy("key")
