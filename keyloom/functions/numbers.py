"""Integer math on columns and 256-bit wrapping integers as eight 32-bit limbs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

LIMBS = tuple(f"l{i}" for i in range(8))
_MASK = 0xFFFFFFFF


def div_round_up(x: Column, y: Column | int) -> Column:
    """ceil(x / y) of non-negative integers."""
    y = F.lit(y) if isinstance(y, int) else y
    return ((x + y - 1 - (x + y - 1) % y) / y).cast("long")


def ceil_log2(x: Column) -> Column:
    """Least k with 2**k >= x, for x >= 1: the bits of x - 1."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("int")


def next_power_of_two(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), ceil_log2(x))


def floor_log2(x: Column) -> Column:
    return (F.length(F.bin(x)) - 1).cast("int")


def reverse_bits(x: Column, width: int) -> Column:
    """The lowest `width` bits of x in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(x), width, "0")), 2, 10).cast("long")


def common_suffix_length(a: Column, b: Column) -> Column:
    """Number of equal low bits of two different longs; 64 if they are equal."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, F.lit(64)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("int")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def tree_depth(size: Column, path: Column, last: Column) -> Column:
    """Level of the leaf `path` in a tree with `size` leaves; last: ceil_log2(size)."""
    half = F.when(last > 0, _bit(last - 1)).otherwise(F.lit(0))
    return F.when(path.bitwiseOR(half) < size, last).otherwise(last - 1)


def tree_node(size: Column, path: Column, last: Column, level: Column) -> Column:
    """Node on the way to the leaf `path` at a level; see tree_nodes."""
    half = F.when(last > 0, _bit(last - 1)).otherwise(F.lit(0))
    missing = F.when((level == last) & (path >= half), _bit(last) - size).otherwise(F.lit(0))
    return _bit(level) - 1 + path.bitwiseAND(_bit(level) - 1) - missing


def tree_nodes(size: Column, path: Column) -> Column:
    """Array of struct(level, node): nodes from the root to the leaf `path` of a tree with `size` leaves, kept level by level.

    Level i starts at 2**i - 1 and takes the low i bits of the path. If size is no power of two the last level misses
    2**last - size nodes: paths whose sibling there would be beyond the leaves end one level earlier, and the nodes of
    the second half of the last level move up by the missing ones. All nodes are below 2 * size - 1."""
    last = ceil_log2(size)
    return F.transform(F.sequence(F.lit(0), tree_depth(size, path, last)), lambda i: F.struct(i.alias("level"), tree_node(size, path, last, i).alias("node")))


def tree_node_rows(df: DataFrame, *keep: str) -> DataFrame:
    """keep, level and node of df's size and path columns: tree_nodes with a row for each node.

    A lambda over an array is interpreted, row after row; levels that are exploded first are compiled."""
    own = df.withColumn("_last", ceil_log2(F.col("size")))
    size, path, last = F.col("size"), F.col("path"), F.col("_last")
    rows = own.select("*", F.explode(F.sequence(F.lit(0), tree_depth(size, path, last))).alias("level"))
    return rows.select(*keep, "level", tree_node(size, path, last, F.col("level")).alias("node"))


@F.pandas_udf(StructType([StructField(x, LongType()) for x in LIMBS]))
def parse_u256(text: pd.Series) -> pd.DataFrame:
    """Limbs of a decimal string, modulo 2**256; null for null."""
    rows = [[None] * 8 if t is None else [(int(t) % (1 << 256)) >> (32 * i) & _MASK for i in range(8)] for t in text]
    return pd.DataFrame(rows, columns=list(LIMBS), dtype="Int64")


@F.pandas_udf(StringType())
def render_u256(limbs: pd.DataFrame) -> pd.Series:
    """Decimal string of struct(l0..l7)."""
    return pd.Series([None if any(pd.isna(x) for x in row) else str(sum(int(x) << (32 * i) for i, x in enumerate(row))) for row in limbs[list(LIMBS)].itertuples(index=False)], dtype="object")


@F.pandas_udf(StringType())
def render_signed(limbs: pd.DataFrame) -> pd.Series:
    """Decimal string of struct(l0..l7) read as a signed 256-bit integer."""
    whole = [sum(int(x) << (32 * i) for i, x in enumerate(row)) for row in limbs[list(LIMBS)].itertuples(index=False)]
    return pd.Series([str(x - (1 << 256) if x >> 255 else x) for x in whole], dtype="object")


def sort_key(limbs: Iterable[Column]) -> Column:
    """64 hex digits, most significant first: their order is the order of the numbers."""
    return F.concat(*[F.lower(F.lpad(F.hex(x), 8, "0")) for x in reversed(list(limbs))])


def carried(df: DataFrame, sums: Iterable[str] = LIMBS) -> DataFrame:
    """Limb sums of either sign to limbs: the carry runs up, the last one is dropped (that is the wrap).

    Column by column, so that each carry is computed once."""
    carry = F.lit(0).cast("long")
    for name in sums:
        df = df.withColumn("_x", F.col(name) + carry)
        df = df.withColumns({name: F.col("_x").bitwiseAND(F.lit(_MASK)), f"_k{name}": F.shiftright("_x", 32)})
        carry = F.col(f"_k{name}")
    return df.drop("_x", *[f"_k{n}" for n in sums])


def is_zero(limbs: Iterable[str] = LIMBS) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x) == 0 for x in limbs])
