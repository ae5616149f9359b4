"""Transfer ledgers: a log of transfers with repeats and re-organisations to balances, change sets and lookups.

A log has ord (its row order), block, log_idx, from_addr, to_addr and an amount, either one long column (small
units) or eight limbs l0..l7 of a 256-bit integer. Balances have addr and the same amount columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import normalize_address
from ..functions.numbers import LIMBS, carried, is_zero, sort_key
from .order import Running, running
from .table import KeyedTable

#: Blocks behind the newest one that may still change.
FINALITY = 10


@dataclass(frozen=True)
class Amount:
    """The columns of an amount. Limbs wrap modulo 2**256; a long doesn't, it raises beyond its range."""

    columns: tuple[str, ...] = ("amount",)

    @property
    def wide(self) -> bool:
        return len(self.columns) > 1

    def zero(self) -> Column:
        return is_zero(self.columns) if self.wide else F.col(self.columns[0]) == 0

    def order(self) -> Column:
        return sort_key(F.col(c) for c in self.columns) if self.wide else F.col(self.columns[0])

    def settle(self, df: DataFrame) -> DataFrame:
        return carried(df, self.columns) if self.wide else df


LONG, U256 = Amount(), Amount(LIMBS)


def place() -> Column:
    return F.struct("block", "log_idx")


def normalized(log: DataFrame, *columns: str) -> DataFrame:
    """log with its addresses in the form 0x and 40 digits; one bad address fails the batch."""
    return log.withColumns({c: normalize_address(F.col(c)) for c in columns or ("from_addr", "to_addr")})


def not_final(log: DataFrame, last_block: int, lag: int = FINALITY) -> DataFrame:
    """Rows above the finality line of the last batch; the others were settled then."""
    return log.where(F.col("block") > last_block - lag)


def late_rows(log: DataFrame, last_block: int, lag: int = FINALITY) -> int:
    """How many rows come too late: at or below the finality line of the last batch."""
    return log.where(F.col("block") <= last_block - lag).count()


def is_stale(log: DataFrame, last_block: int) -> bool:
    """No rows, or the last row is of an older block than the last batch's."""
    last = log.agg(F.max_by("block", "ord").alias("b")).first().b
    return last is None or last < last_block


def dedup_last_wins(log: DataFrame) -> DataFrame:
    """Keeps rows whose (block, log_idx) is below those of all later rows: after a re-organisation the later row counts.

    The last row, normally a heartbeat, only closes the log and always goes."""
    after = running(log, "ord", {"_after": Running("min", place(), after=True)})
    return after.where(place() < F.col("_after")).drop("_after")


def dedup_first_wins(log: DataFrame, cursor: tuple[int, int] | None = None) -> DataFrame:
    """Keeps rows whose (block, log_idx) is above those of all earlier rows and above the cursor: what is read again goes."""
    before = running(log, "ord", {"_before": Running("max", place())})
    seen = F.col("_before").isNull() | (place() > F.col("_before"))
    if cursor is not None:
        seen = seen & (place() > F.struct(F.lit(cursor[0]).cast(log.schema["block"].dataType).alias("block"), F.lit(cursor[1]).cast(log.schema["log_idx"].dataType).alias("log_idx")))
    return before.where(seen).drop("_before")


def split_final(log: DataFrame, new_last: int, lag: int = FINALITY) -> tuple[DataFrame, DataFrame]:
    """Stable and unstable rows."""
    stable = F.col("block") <= new_last - lag
    return log.where(stable), log.where(~stable)


def fold(log: DataFrame, amount: Amount = LONG, *by: str) -> DataFrame:
    """addr and the net amount of all transfers: debits and credits, summed; for each value of further columns, if any.
    Zero sums stay.

    Both sides of a row come from one pass, and sums combine before the shuffle, so a hot account is no hot task."""
    sides = F.explode(F.array(F.struct(F.col("from_addr").alias("addr"), F.lit(-1).alias("sign")), F.struct(F.col("to_addr").alias("addr"), F.lit(1).alias("sign"))))
    rows = log.select(sides.alias("s"), *by, *amount.columns)
    return amount.settle(rows.groupBy(F.col("s.addr").alias("addr"), *by).agg(*[F.sum(F.col("s.sign") * F.col(c)).alias(c) for c in amount.columns]))


def total(parts: Sequence[tuple[int, DataFrame]], amount: Amount = LONG) -> DataFrame:
    """Sum of signed balance tables by address."""
    rows = reduce(DataFrame.unionByName, [d.select("addr", *[(F.lit(sign) * F.col(c)).alias(c) for c in amount.columns]) for sign, d in parts])
    return amount.settle(rows.groupBy("addr").agg(*[F.sum(c).alias(c) for c in amount.columns]))


def apply_delta(balances: DataFrame, delta: DataFrame, amount: Amount = LONG) -> DataFrame:
    """Balances after a delta; accounts that come to zero go."""
    return total([(1, balances), (1, delta)], amount).where(~amount.zero())


def served_delta(delta: DataFrame, old_unstable: DataFrame, new_unstable: DataFrame, amount: Amount = LONG) -> DataFrame:
    """What changes in the served balances (stable plus unstable) when the old unstable part is taken back."""
    return total([(1, delta), (-1, old_unstable), (1, new_unstable)], amount).where(~amount.zero())


def changes(old: DataFrame, new: DataFrame, amount: Amount = LONG) -> DataFrame:
    """Change set between two balance tables (missing: zero): addr, the new amount and op (insert, update, delete)."""
    n = [F.coalesce(F.col(f"n.{c}"), F.lit(0)) for c in amount.columns]
    o = [F.coalesce(F.col(f"o.{c}"), F.lit(0)) for c in amount.columns]
    all_zero = lambda xs: reduce(lambda a, b: a & b, [x == 0 for x in xs])
    differs = reduce(lambda a, b: a | b, [x != y for x, y in zip(n, o, strict=True)])
    op = F.when(all_zero(n), "delete").when(~all_zero(o), "update").otherwise("insert")
    return old.alias("o").join(new.alias("n"), "addr", "full_outer").where(differs).select("addr", *[x.alias(c) for x, c in zip(n, amount.columns, strict=True)], op.alias("op"))


def apply_changes(served: DataFrame, change_set: DataFrame, amount: Amount = LONG) -> tuple[DataFrame, DataFrame]:
    """The served table after a change set, and one row of mismatches: inserts of what was there, updates and deletes of
    what was not."""
    both = served.withColumn("_had", F.lit(True)).alias("s").join(change_set.withColumn("_new", F.lit(True)).alias("c"), "addr", "full_outer")
    after = both.where(F.coalesce(F.col("op") != "delete", F.lit(True)))
    after = after.select("addr", *[F.when(F.col("_new"), F.col(f"c.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in amount.columns])
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    wrong = both.agg(n(F.col("_had") & (F.col("op") == "insert")).alias("inserts"), n(F.col("_had").isNull() & F.col("op").isin("update", "delete")).alias("others"))
    return after, wrong


def lookup(queries: DataFrame, served: DataFrame, till_block: int | None, amount: Amount = LONG) -> DataFrame:
    """queries (with addr) plus the balance, zero on a miss, till_block and success."""
    out = queries.join(served, "addr", "left").select(*queries.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in amount.columns])
    return out.withColumns({"till_block": F.lit(till_block).cast("long"), "success": F.lit(True)})


def top(balances: DataFrame, n: int | None = None, amount: Amount = LONG) -> DataFrame:
    """Balances, the greatest first, ties by address; n: a top-n report."""
    out = balances.orderBy(amount.order().desc(), "addr")
    return out if n is None else out.limit(n)


def served_table(served: DataFrame, records: int, spare: float = 1.2) -> KeyedTable:
    """Served balances as a keyed table with room for more accounts than the records that are stored."""
    return KeyedTable(served, ["addr"], capacity=int(records * spare))


def nest(log: DataFrame) -> DataFrame:
    """block, tx_hash, events: a map from log_idx to its transfer, for each transaction."""
    entry = F.struct("log_idx", F.struct("from_addr", "to_addr", "amount"))
    return log.groupBy("block", "tx_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("events"))
