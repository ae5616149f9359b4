import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import bytes as B
from keyloom.functions import numbers
from keyloom.operators import routing
from keyloom.operators.order import position_within
from keyloom.operators.stored import KeyValueStore, StoredTable
from keyloom.operators.table import DuplicateKeyError, KeyedTable
from keyloom.sources import files
from keyloom.sources.folders import Pointer, checkpoint_dir, names

SCHEMA = "ord int, key int, value int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(table):
    return {r.key: r.value for r in table.rows().collect()}


def test_batches_against_a_dict(spark, tmp_path):
    rnd, model = random.Random(4), {k: k for k in range(0, 60, 2)}
    own = StoredTable.create(str(tmp_path / "t"), spark.createDataFrame(list(model.items()), "key int, value int"), ["key"], shards=5, made="here")
    for step in range(8):
        rows = [(i, rnd.randrange(80), rnd.randrange(1000)) for i in range(25)] + [(99, None, 1)]
        if step % 3 == 2:
            flags = own.erase_batch(frame(spark, rows))
            after = {k: v for k, v in model.items() if k not in {r[1] for r in rows}}
        else:
            flags = own.insert_batch(frame(spark, rows), "ord")
            after = {**model, **{k: v for _, k, v in rows if k is not None}}
        assert {(r.ord, r.key): r.existed for r in flags.collect()} == {(o, k): k in model for o, k, _ in rows}
        model = after
        if step == 4:
            own.compact()
            assert own.state["runs"] == []
        own = StoredTable(spark, str(tmp_path / "t"))  # opened anew
        assert content(own) == model and own.count() == len(model) and own.entries() == {"made": "here"}
        probe = frame(spark, [(i, k, -5) for i, k in enumerate([1, 1, 2, 40, 79, None])])
        got = own.find_batch(probe)
        assert got.columns == ["ord", "key", "value", "found"]
        assert {(r.ord, r.key): (r.value, r.found) for r in got.collect()} == {(i, k): (model.get(k), k in model) for i, k in enumerate([1, 1, 2, 40, 79, None])}
    own.compact_if_due(1)
    own.vacuum()
    assert content(StoredTable(spark, str(tmp_path / "t"))) == model


def test_a_batch_reads_and_writes_its_shards_only(spark, tmp_path):
    own = StoredTable.create(str(tmp_path / "t"), spark.range(1000).select(F.col("id").cast("int").alias("key"), F.lit(0).alias("value")), ["key"], shards=50)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    one = frame(spark, [(0, 7, 1)])
    assert len(own.keyed(one).df.inputFiles()) == 1
    own.insert_batch(one, "ord")
    now = list((tmp_path / "t").rglob("*.parquet"))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and len(now) <= len(before) + 2
    own.compact()
    assert sum(r == "run-0" for r in own.state["base"].values()) == 49 and own.count() == 1000


def test_a_failed_change_leaves_what_was(spark, tmp_path):
    own = StoredTable.create(str(tmp_path / "t"), spark.createDataFrame([(1, 1)], "key int, value int"), ["key"])
    bad = frame(spark, [(0, 1, 2)]).withColumn("value", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        own.insert_batch(bad, "ord")
    assert content(StoredTable(spark, str(tmp_path / "t"))) == {1: 1}
    with pytest.raises(DuplicateKeyError):
        StoredTable.create(str(tmp_path / "u"), spark.createDataFrame([(1, 1), (1, 2)], "key int, value int"), ["key"])
    with pytest.raises(FileNotFoundError):
        StoredTable(spark, str(tmp_path / "u"))


def test_key_value_store(spark, tmp_path):
    store = KeyValueStore(spark, str(tmp_path / "s"))
    assert store.get("a") is None and store.get("a", "none") == "none" and not store.delete("a")
    store.put("a", "1")
    store.put("a", "2")
    kv = lambda pairs: spark.createDataFrame(pairs, "key string, value string")
    store.write_batch(kv([("b", "3"), ("c", "4")]), kv([("a", ""), ("c", "")]).select("key"))
    store = KeyValueStore(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in store.items().collect()] == [("b", "3"), ("c", "4")] and [r.key for r in store.items("c").collect()] == ["c"]
    assert store.delete("b") and [(r.key, r.found) for r in store.get_many(kv([("b", ""), ("c", "")]).select("key")).orderBy("key").collect()] == [("b", False), ("c", True)]


def test_columns_of_requests_may_have_any_name(spark):
    own = KeyedTable(spark.createDataFrame([(1, 10)], "key int, value int"), ["key"])
    probe = spark.createDataFrame([(0, 1, 5, "x", "y"), (1, 2, 6, "x", "y")], "ord int, key int, value int, found string, existed string")
    assert [(r.ord, r.value, r.found) for r in own.find_batch(probe).orderBy("ord").collect()] == [(0, 10, True), (1, None, False)]
    table, flags = own.insert_batch(probe, "ord")
    assert [(r.value, r.existed) for r in flags.orderBy("ord").collect()] == [(5, True), (6, False)] and table.count() == 2
    assert own.find_batch(own.df).first().found


def test_log_lines_keep_their_order(spark, tmp_path):
    line = lambda i: f"{i}\t0x{i}\t{i % 10}\t0x1\t0x2\t5\t0\n"
    sizes = {"a.csv": range(3), "b.csv": range(100, 5000), "c.csv": range(6000, 6010)}  # Spark deals the largest first
    (tmp_path / "log").mkdir()
    for name, blocks in sizes.items():
        (tmp_path / "log" / name).write_text("".join(map(line, blocks)))
    got = [r.block for r in files.read_log(spark, str(tmp_path / "log")).orderBy("ord").collect()]
    assert got == [i for blocks in sizes.values() for i in blocks]
    folder, want = str(tmp_path / "parts"), []
    for part in (3, 1, 2):
        rows = [(1000 * part + i, "0x0", i, "0x1", "0x2", "5", "0", 997 * i % 40) for i in range(40)]
        files.append_log(spark.createDataFrame(rows, files.LOG_SCHEMA + ", o int").repartition(3), folder, "o")
        want += [r[0] for r in sorted(rows, key=lambda r: r[-1])]
    assert [r.block for r in files.read_log(spark, folder).orderBy("ord").collect()] == want


def test_trees_of_any_size(spark):
    for size in (1, 2, 3, 4, 5, 6, 7, 11, 100, 1000, 1024):
        own = {r.p: [x.node for x in r.n] for r in spark.range(size).select(F.col("id").alias("p"), numbers.tree_nodes(F.lit(size).cast("long"), F.col("id")).alias("n")).collect()}
        assert all(a < b < max(2, 2 * size - 1) for n in own.values() for a, b in zip(n, n[1:], strict=False))
        some = random.Random(size).sample(sorted(own), min(size, 40))
        for p in some:
            for q in some:
                if p != q:
                    same = ((p ^ q) & -(p ^ q)).bit_length()  # nodes that two paths share
                    assert own[p][:same] == own[q][:same] and not set(own[p][same:]) & set(own[q][same:])


def test_ctr_vectors(spark):
    """NIST SP 800-38A, F.5.5."""
    key, start = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e5130c81c46a35ce411e5fbc1191a0a52eff69f2445df4f9b17ad2b417be66c3710")
    sealed = bytes.fromhex("601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c52b0930daa23de94ce87017ba2d84988ddfc9c58db67aada613c2dd08457941a6")
    df = spark.createDataFrame([(plain[:n],) for n in (64, 33, 16, 1, 0)], "p binary")
    own = lambda c: B.ctr(F.col(c), F.lit(key), F.lit(start[:12]), int.from_bytes(start[12:], "big"))
    for r in df.withColumn("c", own("p")).withColumn("back", own("c")).collect():
        assert bytes(r.c) == sealed[: len(r.p)] and bytes(r.back) == bytes(r.p)


def test_places_within_hot_groups(spark):
    rows = [(i, "hot" if i % 10 else f"g{i % 7}") for i in random.Random(2).sample(range(5000), 2000)] + [(9000, None), (9001, None)]
    got = {r.i: r.pos for r in position_within(spark.createDataFrame(rows, "i long, g string"), "g", "i").collect()}
    seen = {}
    for i, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]
    first = {r.i: (r.v, r.is_first) for r in routing.propagate(spark.createDataFrame([(i, g, i * 2) for i, g in rows], "i long, g string, v long"), "g", "i", "v").collect()}
    least = {g: min(i for i, x in rows if x == g) for _, g in rows}
    assert first == {i: (2 * least[g], i == least[g]) for i, g in rows}


def test_rows_reach_a_sink(spark, tmp_path):
    folder = tmp_path / "sink"
    folder.mkdir()

    def sink(rows):
        got = [r.id for r in rows]
        if got:
            (folder / str(min(got))).write_text(" ".join(map(str, got)))

    files.handed_to(spark.range(50), sink)
    assert sorted(int(x) for p in folder.iterdir() for x in p.read_text().split()) == list(range(50))


def test_pointer_and_folders(spark, tmp_path):
    p = Pointer(spark, str(tmp_path))
    assert p.read() is None and names(spark, str(tmp_path / "none")) == []
    for i in range(3):
        p.write({"version": i})
        assert Pointer(spark, str(tmp_path)).read() == {"version": i}
    assert checkpoint_dir(spark)
