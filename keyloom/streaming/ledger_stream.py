"""The ledger as a restartable stream: micro-batches of the log go through the ledger operators into a stored table.

A batch writes what it changes as one run on top of the stable balances, together with the unstable part, the change
set and the state (last block and index, accounts, late rows, the batch's number): all becomes current at once. A batch
that Spark runs again is skipped, and a crash leaves what was there before. The finality lag is counted in blocks, not in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ledger
from ..operators.ledger import LONG, Amount
from ..operators.stored import StoredTable
from ..operators.table import KeyedTable


def _empty(spark: SparkSession, amount: Amount) -> DataFrame:
    return spark.createDataFrame([], "addr string, " + ", ".join(f"{c} bigint" for c in amount.columns))


class LedgerState:
    """Served balances over a stored table below root."""

    def __init__(self, spark: SparkSession, root: str, amount: Amount = LONG, lag: int = ledger.FINALITY) -> None:
        self.spark, self.root, self.amount, self.lag = spark, root, amount, lag

    def _store(self) -> StoredTable:
        return StoredTable(self.spark, self.root)

    def start(self, balances: DataFrame | None = None, last_block: int = -1, last_idx: int = -1) -> None:
        """The first state, unless there is one."""
        try:
            self._store()
        except FileNotFoundError:
            none = _empty(self.spark, self.amount)
            own = balances if balances is not None else none
            tables = {"unstable": none, "changes": none.withColumn("op", F.lit(""))}
            StoredTable.create(self.root, own, ["addr"], tables=tables, last_block=last_block, last_idx=last_idx, records=own.count(), late=0, batch=-1)

    def entries(self) -> dict:
        """last_block, last_idx, records (accounts in the stable balances), late (rows that came too late), batch."""
        return self._store().entries()

    def apply(self, log: DataFrame, batch: int) -> bool:
        """One batch of log rows (with ord). False if it changed nothing: seen before, stale or empty."""
        self.start()
        store, amount = self._store(), self.amount
        was = store.entries()
        if batch <= was["batch"]:
            return False
        log = log.persist()  # read by several jobs; lost parts are read again
        try:
            late = ledger.late_rows(log, was["last_block"], self.lag)
            rows = ledger.not_final(log, was["last_block"], self.lag)
            last = rows.agg(F.max_by(F.struct("block", "log_idx"), "ord").alias("x")).first().x
            if last is None or last.block < was["last_block"]:
                return False
            kept = ledger.dedup_last_wins(ledger.normalized(rows))
            # Both parts from one pass over the log.
            both = ledger.fold(kept.withColumn("_stable", F.col("block") <= last.block - self.lag), amount, "_stable").where(~amount.zero()).persist()
            delta, new_unstable = (both.where(x).drop("_stable") for x in ("_stable", "not _stable"))
            old_unstable = store.table("unstable").where(~amount.zero()).persist()
            touched = delta.select("addr").union(new_unstable.select("addr")).union(old_unstable.select("addr")).distinct()
            before = store.keyed(touched).df.join(touched, "addr", "left_semi").persist()
            after = ledger.total([(1, before), (1, delta)], amount).join(delta.select("addr"), "addr", "left_semi")
            after = after.join(before.select("addr", F.lit(True).alias("_had")), "addr", "left").withColumns({"_had": F.coalesce("_had", F.lit(False)), "_gone": amount.zero()})
            after = after.where("_had or not _gone").persist()
            grown = after.agg(F.coalesce(F.sum(F.when(F.col("_gone"), -1).when(~F.col("_had"), 1).otherwise(0)), F.lit(0)).alias("n")).first().n
            served = [ledger.total(x, amount).where(~amount.zero()) for x in ([(1, before), (1, old_unstable)], [(1, before), (1, delta), (1, new_unstable)])]
            store.commit(
                after.drop("_had"),
                {"unstable": new_unstable, "changes": ledger.changes(*served, amount)},
                last_block=last.block, last_idx=last.log_idx, records=was["records"] + grown, late=was["late"] + late, batch=batch,
            )
            for df in (both, old_unstable, before, after):
                df.unpersist()
        finally:
            log.unpersist()
        store.compact_if_due()
        return True

    def changes(self) -> DataFrame:
        """What the last batch changed in the served balances."""
        return self._store().table("changes")

    def served(self) -> DataFrame:
        """Stable plus unstable balances that are not zero. The unstable part survives a restart."""
        store = self._store()
        return ledger.total([(1, store.rows()), (1, store.table("unstable"))], self.amount).where(~self.amount.zero())

    def served_table(self) -> KeyedTable:
        """The served balances as a keyed table with room for a fifth more accounts than are stored."""
        return ledger.served_table(self.served(), self.entries()["records"])

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Balances of the accounts asked for; only the shards that they are in are read."""
        store = self._store()
        asked = queries.select("addr").distinct()
        found = [(1, d.join(asked, "addr", "left_semi")) for d in (store.keyed(asked).df, store.table("unstable"))]
        return ledger.lookup(queries, ledger.total(found, self.amount), store.entries()["last_block"], self.amount)

    def vacuum(self) -> None:
        """Deletes files that are no longer current."""
        self._store().vacuum()


def run(log: DataFrame, state: LedgerState, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Starts the stream over a streaming log with block, log_idx, from_addr, to_addr, ord and amount columns.

    every=None: what is there now, then stop."""
    state.start()
    writer = log.writeStream.foreachBatch(lambda df, batch: state.apply(df, batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
