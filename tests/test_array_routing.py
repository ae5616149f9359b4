import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import capacity, numbers
from keyloom.operators import routing
from keyloom.operators.array import AddressedArray
from keyloom.operators.order import Running, running


def test_default_and_write(spark):
    a = AddressedArray.filled(spark, 12345, 31)
    a = a.write_batch(spark.createDataFrame([(0, 0, 1235)], "ord int, addr long, value long"), "ord")
    got = a.read_batch(spark.createDataFrame([(0,), (1,)], "addr long")).orderBy("addr").collect()
    assert [r.value for r in got] == [1235, 31]
    with pytest.raises(Exception, match="no such address"):
        a.read_batch(spark.createDataFrame([(12345,)], "addr long")).collect()


def test_records_need_the_size(spark):
    rows = spark.createDataFrame([(5, 50), (3, 30), (9, 90)], "ord long, value long")
    assert [r.value for r in AddressedArray.from_records(rows, 3, "ord").dense().orderBy("addr").collect()] == [30, 50, 90]
    with pytest.raises(ValueError):
        AddressedArray.from_records(rows, 4, "ord")


def test_random_first_wins(spark):
    rnd = random.Random(3)
    cells = [7] * 20
    a = AddressedArray.filled(spark, 20, 7)
    for _ in range(3):
        batch = [(i, rnd.randrange(20), rnd.randrange(1000)) for i in range(15)]
        a, got = a.access_batch(spark.createDataFrame(batch, "ord long, addr long, x long").drop("x"), "ord", lambda v: v + 1)
        assert {r.ord: r.value for r in got.collect()} == {o: cells[x] for o, x, _ in batch}
        for x in {x for _, x, _ in batch}:
            cells[x] += 1
        batch = [(i, rnd.randrange(20), rnd.randrange(1000)) for i in range(15)]
        a = a.write_batch(spark.createDataFrame(batch, "ord long, addr long, value long"), "ord")
        for x, v in {x: v for _, x, v in reversed(batch)}.items():
            cells[x] = v
        assert [r.value for r in a.dense().orderBy("addr").collect()] == cells


def test_running_matches_plain_windows(spark):
    rnd = random.Random(4)
    v = [rnd.randrange(100) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(v)), "ord long, v long")
    out = running(df, "ord", {"s": Running("sum", F.col("v")), "lo": Running("min", F.col("v"), after=True), "hi": Running("max", F.col("v")), "n": Running("count", F.col("v"))}, n=7)
    for r in out.collect():
        assert (r.s, r.n) == (sum(v[: r.ord]), r.ord)
        assert r.lo == min(v[r.ord + 1 :], default=None) and r.hi == max(v[: r.ord], default=None)


def test_compact_and_distribute_are_inverse(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "ord long, m boolean")
    packed = routing.compact(df, "ord", F.col("m")).select(F.col("pos").alias("item"), F.col("ord").alias("came_from"))
    back = routing.distribute(packed, "item", df, "ord", F.col("m")).collect()
    assert all(r.came_from == (r.ord if r.m else None) for r in back)


def test_capacity_checks(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "key long")
    with pytest.raises(routing.BucketOverflow):
        routing.split_two_ways(df, "key", F.col("key") > 2, 6)
    assert routing.split_two_ways(df, "key", F.col("key") > 2, 7).count() == 14
    with pytest.raises(routing.BucketOverflow):
        routing.route(df.withColumn("shard", F.lit(1)), "shard", 4, capacity=9)


def test_padding_hides_loads(spark):
    df = spark.createDataFrame([(0, k) for k in range(5)] + [(2, 9), (2, 9)], "shard int, key int")
    out = routing.pad_shards(df, "shard", "key", 4, bound=3)
    assert {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()} == dict.fromkeys(range(4), 5)
    assert out.where("key is not null").count() == 6


def test_binomial_sizes():
    n = capacity.max_per_shard(1000, 8)
    assert capacity.log2_tail(n, 1000, 1 / 8) < -40 <= capacity.log2_tail(n - 1, 1000, 1 / 8)
    assert capacity.max_per_shard(1, 8) == 1
    assert capacity.suitable_shards(3) == 2 and capacity.suitable_shards(1000) <= 64
    assert capacity.shard_factors(12) == [3, 4] and capacity.shard_factors(24) == [3, 8] and capacity.shard_factors(60) == [3, 4, 5]
    for n in (0, 1, 11, 22, 65, 72):
        with pytest.raises(ValueError, match="shards"):
            capacity.shard_factors(n)
    assert 0 < capacity.real_per_bucket(4096, 4) < 4096
    assert abs(capacity.log2_add(3, 3) - 4) < 1e-12


def test_integer_math(spark):
    x = F.col("id")
    df = spark.range(1, 300).select("id", numbers.ceil_log2(x).alias("c"), numbers.next_power_of_two(x).alias("p"), numbers.reverse_bits(x, 9).alias("r"), numbers.div_round_up(x, 7).alias("d"), numbers.common_suffix_length(x, F.lit(12).cast("long")).alias("s"))
    for r in df.collect():
        assert 2**r.c >= r.id > (2 ** (r.c - 1) if r.c else 0) and r.p == 2**r.c and r.d == -(-r.id // 7)
        assert r.r == int(f"{r.id:09b}"[::-1], 2)
        assert r.s == (64 if r.id == 12 else ((r.id ^ 12) & -(r.id ^ 12)).bit_length() - 1)


def test_u256(spark):
    values = [0, 1, 2**32, 2**255, 2**256 - 1, -1, 123456789012345678901234567890]
    df = spark.createDataFrame([(str(v),) for v in values], "t string").withColumn("x", numbers.parse_u256("t"))
    assert [r.b for r in df.select(numbers.render_u256("x").alias("b")).collect()] == [str(v % 2**256) for v in values]
    assert df.select(numbers.render_signed("x").alias("b")).collect()[5].b == "-1"
    keyed = df.select("t", numbers.sort_key([F.col(f"x.{n}") for n in numbers.LIMBS]).alias("k")).orderBy("k").collect()
    assert [int(r.t) % 2**256 for r in keyed] == sorted(v % 2**256 for v in values)
