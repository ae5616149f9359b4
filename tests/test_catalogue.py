import pytest
from pyspark.sql import functions as F

from keyloom.functions import numbers
from keyloom.plans import queries
from keyloom.plans.queries import QUERIES, SQL

from .oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        check(spark, con, QUERIES[name], SQL[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_roundtrip_is_whole(spark):
    assert QUERIES["encrypt_roundtrip"](spark, SF).where("not same").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0 and "till_block" in out.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reverse_bits_of_large_keys(spark, tmp_path):
    keys = [1, 65535, 65536, 99_999]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.key: r.reversed for r in QUERIES["reverse_bits"](spark, str(tmp_path)).collect()}
    assert got == {k: int(f"{k:017b}"[::-1], 2) for k in keys}


def test_split_two_ways_of_many_suppliers(spark, tmp_path):
    spark.range(1, 3001).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["split_two_ways"](spark, str(tmp_path)).collect()
    assert sorted(r.key for r in got if r.key is not None) == list(range(1, 3001)) and len(got) == 3000
    assert all(r.key % 2 == r.side for r in got if r.key is not None)


def test_tree_paths_are_many_tasks_work(spark, tmp_path):
    """A part gives dozens of rows: one split of parts may not make them all."""
    spark.range(3000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["tree_path_nodes"](spark, str(tmp_path))
    made = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(made) == 4 and max(made) < 0.3 * sum(made)
    whole = got.where("size = 1000 AND key = 2999").orderBy("level").collect()
    expected = spark.range(1).select(F.inline(numbers.tree_nodes(F.lit(1000).cast("long"), F.lit(999).cast("long")))).collect()
    assert [(r.level, r.node) for r in whole] == [(r.level, r.node) for r in expected]


def test_a_micro_batch_is_many_tasks_work(spark, monkeypatch):
    """What is in one file is one task's: a part of the log is several files, and still one micro-batch."""
    seen, apply = [], queries.LedgerState.apply

    def counted(state, log, batch):
        seen.append((batch, log.select(F.input_file_name()).distinct().count()))
        return apply(state, log, batch)

    monkeypatch.setattr(queries.LedgerState, "apply", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries._ledger_state(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [batch for batch, _ in seen] == [0, 1, 2] and min(n for _, n in seen) > 1
