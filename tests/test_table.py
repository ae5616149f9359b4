import random

import pytest

from keyloom.operators.oplog import final_state, replay
from keyloom.operators.table import CapacityError, DuplicateKeyError, KeyedTable


def frame(spark, rows, schema="ord int, key int, value int"):
    return spark.createDataFrame(rows, schema)


def content(table):
    return {r.key: r.value for r in table.df.collect()}


def test_literal_find(spark):
    t = KeyedTable(frame(spark, [(0, 123, 1), (1, 456, 2), (2, 789, 3), (3, 101112, 4)]).drop("ord"), ["key"])
    got = t.find_batch(frame(spark, [(i, k, 0) for i, k in enumerate([789, 456, 678, 123, 456])]).drop("value")).orderBy("ord").collect()
    assert [r.value for r in got] == [3, 2, None, 1, 2]
    assert [r.found for r in got] == [True, True, False, True, True]


def test_literal_builder_then_insert(spark):
    kv = lambda rows: frame(spark, [(i, k, v) for i, (k, v) in enumerate(rows)])
    t = KeyedTable.builder(["key"]).add(kv([(789, 3), (123, 1)]), "ord").add(kv([(456, 2), (101112, 4)]), "ord").finalize("error")
    t, flags = t.insert_batch(kv([(654, 1), (123, 2), (789, 3), (678, 4)]), "ord")
    assert [r.existed for r in flags.orderBy("ord").collect()] == [False, True, True, False]
    got = t.find_batch(kv([(789, 0), (456, 0), (678, 0), (123, 0), (456, 0), (4, 0)]).drop("value")).orderBy("ord").collect()
    assert [r.value for r in got] == [3, 2, 4, 2, 2, None]


def test_erase_twice(spark):
    t = KeyedTable(frame(spark, [(0, 123, 1)]).drop("ord"), ["key"])
    t, flags = t.erase({"key": 123})
    assert flags.first().existed
    t, flags = t.erase({"key": 123})
    assert not flags.first().existed and t.count() == 0


def test_single_operations(spark):
    t = KeyedTable.empty(spark, "key int, value int", ["key"])
    t, f = t.insert({"key": 1}, {"value": 10})
    assert not f.first().existed
    t, f = t.update({"key": 2}, {"value": 5})
    assert not f.first().found and content(t) == {1: 10}
    t, f = t.update({"key": 1}, {"value": 11})
    assert f.first().found and t.find({"key": 1}).first().value == 11
    assert t.size_in_bytes() >= 0


def test_strict_load_refuses(spark):
    rows = frame(spark, [(i, i % 5, 0) for i in range(10)])
    with pytest.raises(DuplicateKeyError):
        KeyedTable.load(rows, ["key"], ["value"])
    with pytest.raises(CapacityError):
        KeyedTable.load(rows, ["key"], ["value"], duplicates="last", order="ord", capacity=4)
    last = KeyedTable.load(rows.withColumn("value", rows.ord), ["key"], ["value"], duplicates="last", order="ord")
    assert content(last) == {k: k + 5 for k in range(5)}


def test_null_keys_are_dummies(spark):
    t = KeyedTable(frame(spark, [(0, 1, 1)]).drop("ord"), ["key"])
    batch = frame(spark, [(0, None, 9), (1, 1, 2)])
    after, flags = t.insert_batch(batch, "ord")
    assert content(after) == {1: 2}
    assert [r.existed for r in flags.orderBy("ord").collect()] == [False, True]


def test_null_values_are_values(spark):
    t = KeyedTable(frame(spark, [(0, 1, 1)]).drop("ord"), ["key"])
    after, _ = t.insert_batch(frame(spark, [(0, 1, 5), (1, 1, None)]), "ord")
    assert content(after) == {1: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    rnd, model = random.Random(seed), {}
    t = KeyedTable.empty(spark, "key int, value int", ["key"])
    for step in range(6):
        batch = [(i, rnd.randrange(12), rnd.randrange(100)) for i in range(8)]
        op = rnd.choice("IUE") if step else "I"
        had = [k in model for _, k, _ in batch]
        if op == "E":
            t, flags = t.erase_batch(frame(spark, batch))
            for _, k, _ in batch:
                model.pop(k, None)
        else:
            t, flags = (t.insert_batch if op == "I" else t.update_batch)(frame(spark, batch), "ord")
            keys = set(model)
            model.update({k: v for _, k, v in batch if op == "I" or k in keys})
        assert [r[-1] for r in flags.orderBy("ord").collect()] == had
        t = t.checkpointed()
        assert content(t) == model


def python_replay(log):
    state, out = {}, []
    for _, k, op, v in log:
        out.append((k in state, state.get(k)))
        if op == "I" or (op == "U" and k in state):
            state[k] = v
        elif op == "E":
            state.pop(k, None)
    return out, state


def test_replay(spark):
    rnd = random.Random(5)
    log = [(i, rnd.randrange(6), rnd.choice("IIUUEFF"), rnd.choice([None, *range(50)])) for i in range(400)]
    want, state = python_replay(log)
    df = frame(spark, log, "ord int, key int, op string, value int")
    assert [(r.found, r.found_value) for r in replay(df).orderBy("ord").collect()] == want
    assert {r.key: r.value for r in final_state(df).collect()} == state


def test_replay_of_a_hot_key(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice("IUEF"), rnd.choice([None, *range(50)])) for i in range(600)]
    state, want = {}, {}
    for i, k, op, v in rows:
        want[i] = (k in state, state.get(k))
        if op == "I" or (op == "U" and k in state):
            state[k] = v
        elif op == "E":
            state.pop(k, None)
    df = spark.createDataFrame(rows, "ord long, key int, op string, value int").repartition(5)
    got = {r.ord: (r.found, r.found_value) for r in replay(df).collect()}
    assert got == want
