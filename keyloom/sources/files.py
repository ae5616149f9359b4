"""Files: transfer logs, balance files, performance logs, and snapshots of several tables at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bytes import is_address
from .folders import Pointer, delete, names

LOG_SCHEMA = "block BIGINT, tx_hash STRING, log_idx BIGINT, from_addr STRING, to_addr STRING, value STRING, ts STRING"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated transfer log with ord. A malformed line is an error.

    ord follows the parts that append_log wrote, else the files' names, and the order of lines in each, however Spark
    deals files to tasks: splits are ranked by file and place (one small row for each), lines within them in order."""
    rows = spark.read.csv(path, sep="\t", schema=LOG_SCHEMA, mode="FAILFAST", recursiveFileLookup=True)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    own = rows.select("*", at.alias("_split")).withColumn("_line", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    splits = own.select("_split").distinct().withColumn("_rank", F.row_number().over(W.orderBy("_split")) - 1)
    return own.join(splits, "_split").withColumn("ord", F.shiftleft(F.col("_rank").cast("long"), 33) + F.col("_line")).drop("_split", "_line", "_rank")


def append_log(log: DataFrame, path: str, order: str | None = None) -> None:
    """Adds a part to a log, after all that it has. order: a column that the lines are sorted by, else they stay as they are."""
    n = 1 + max((int(x.removeprefix("part=")) for x in names(log.sparkSession, path) if x.startswith("part=")), default=-1)
    own = log.orderBy(order) if order else log
    own.select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")]).write.csv(f"{path.rstrip('/')}/part={n:012d}", sep="\t")


def heartbeat(spark: SparkSession, block: int) -> DataFrame:
    """The row that closes each saved part of a log: the first columns name its block, the rest are fixed."""
    return spark.createDataFrame([(block, "0x0", 9999999, "0x0", "0x0", "0", "0")], LOG_SCHEMA)


def read_balances(spark: SparkSession, path: str) -> tuple[tuple[int, int, int], DataFrame]:
    """Header (block, idx, count) and rows addr, balance (decimal text) of a balance file. The count isn't verified."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"))
    head = lines.where(F.size("x") == 3).first()
    if head is None:
        raise ValueError(f"no header in {path}")
    return tuple(int(v) for v in head.x), lines.where(F.size("x") == 2).select(F.col("x")[0].alias("addr"), F.col("x")[1].alias("balance"))


def initial_last_block(header: tuple[int, int, int], lag: int = 10) -> int:
    """A balance file is final, so the finality line starts at its own block."""
    return header[0] + lag


def write_balances(balances: DataFrame, path: str, block: int, idx: int, by: str = "balance") -> None:
    """balances (addr, balance, and _key to sort by, greatest first) as one file below path, header first.

    by="addr": in the order of addresses, as a store holds them; _key isn't needed then."""
    spark = balances.sparkSession
    if by == "addr":
        balances = balances.withColumn("_key", F.lit(""))
    head = spark.createDataFrame([(0, "", f"{block} {idx} {balances.count()}")], "part int, key string, value string")
    body = balances.select(F.lit(1).alias("part"), F.col("_key").cast("string").alias("key"), F.concat_ws(" ", "addr", "balance").alias("value"))
    # One file is the format; the sort is global, and only its last step is a single writer.
    head.unionByName(body).orderBy("part", F.desc("key"), "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def accounts(store: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a key-value store whose keys are addresses; the others are metadata."""
    return store.where(is_address(F.col(key)))


def read_perf_log(spark: SparkSession, path: str) -> DataFrame:
    """operation, size, batch, micros, per_second of lines such as `find: size = 100, batchSize = 1, time = 21.7 us`."""
    number = r"([0-9.eE+]+)"
    get = lambda p: F.regexp_extract("value", p, 1)
    rows = spark.read.text(path).select(
        get(r"^\s*(\w+)\s*:").alias("operation"),
        F.try_to_number(get(rf"size\s*=\s*{number}"), F.lit("999999999999999")).cast("long").alias("size"),
        F.try_to_number(get(rf"batchSize\s*=\s*{number}"), F.lit("999999999999")).cast("long").alias("batch"),
        F.expr(r"try_cast(regexp_extract(value, 'time\\s*=\\s*([0-9.eE+-]+)', 1) AS DOUBLE)").alias("micros"),
    )
    return rows.where("operation <> '' AND micros > 0").withColumn("per_second", 1e6 / F.col("micros"))


def generated(spark: SparkSession, n: int, row: Callable[[F.Column], list[F.Column]]) -> DataFrame:
    """A virtual source: row i is made from its number by column expressions."""
    return spark.range(n).select(*row(F.col("id")))


def handed_to(df: DataFrame, sink: Callable[[Iterator], None]) -> None:
    """A virtual sink: every partition's rows go to a callback on the executors. A part may come again after a failure."""
    df.foreachPartition(sink)


class Snapshots:
    """Several tables as one version: written to `v=N` folders, then published by moving a pointer.

    Readers see the version that the pointer names, whole or not at all. All paths go through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pointer = spark, root.rstrip("/"), Pointer(spark, root)

    def meta(self) -> dict | None:
        """What was published last: version and the writer's own entries."""
        return self.pointer.read()

    def read(self, name: str) -> DataFrame:
        """A table of the published version."""
        if (meta := self.meta()) is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/v={meta['version']}/{name}")

    def publish(self, tables: dict[str, DataFrame], **entries) -> int:
        """Writes the tables as the next version, then moves the pointer. Entries are kept with it."""
        version = (self.meta() or {"version": 0})["version"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
        self.pointer.write({"version": version, **entries})
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last versions."""
        version = (self.meta() or {"version": 0})["version"]
        for name in names(self.spark, self.root):
            if name.startswith("v=") and int(name[2:]) <= version - keep:
                delete(self.spark, f"{self.root}/{name}")
