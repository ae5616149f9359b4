import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import numbers
from keyloom.functions.bytes import normalize_address
from keyloom.operators import ledger
from keyloom.sources import files, scanner
from keyloom.streaming.ledger_stream import LedgerState, run

LOG = "ord long, block long, log_idx long, name string"


def rows(spark):
    return spark.createDataFrame([(0, 10, 0, "a"), (1, 11, 0, "b"), (2, 12, 0, "c"), (3, 11, 0, "d"), (4, 12, 1, "e"), (5, 12, 9999999, "heartbeat")], LOG)


def test_literal_dedup(spark):
    assert sorted(r.name for r in ledger.dedup_last_wins(rows(spark)).collect()) == ["a", "d", "e"]
    assert sorted(r.name for r in ledger.dedup_first_wins(rows(spark), (0, 0)).collect()) == ["a", "b", "c", "e", "heartbeat"]


def test_wrap(spark):
    limb = ", ".join(f"{n} long" for n in numbers.LIMBS)
    log = spark.createDataFrame([("a", "b", 1, *[0] * 7)], f"from_addr string, to_addr string, {limb}")
    out = {r.addr: r for r in ledger.fold(log, ledger.U256).collect()}
    assert [out["a"][n] for n in numbers.LIMBS] == [2**32 - 1] * 8 and out["b"].l0 == 1


def test_addresses(spark):
    df = spark.createDataFrame([("0x1a",)], "a string")
    assert df.select(normalize_address(F.col("a")).alias("a")).first().a == "0x" + "0" * 38 + "1a"
    for bad in ("1a", "0x" + "1" * 41, None):
        with pytest.raises(Exception, match="not an address"):
            spark.createDataFrame([(bad,)], "a string").select(normalize_address(F.col("a"))).collect()


def test_stale(spark):
    assert ledger.is_stale(rows(spark).limit(0), 0) and ledger.is_stale(rows(spark), 13) and not ledger.is_stale(rows(spark), 12)


class Model:
    """Row-by-row Python version of one ledger."""

    def __init__(self):
        self.stable, self.unstable, self.last = {}, {}, -1

    def apply(self, log):
        log = [x for x in log if x[1] > self.last - 10]
        if not log or log[-1][1] < self.last:
            return
        last, kept, low = log[-1][1], [], (log[-1][1], log[-1][2])
        for x in reversed(log[:-1]):
            if (x[1], x[2]) < low:
                low = (x[1], x[2])
                kept.append(x)
        self.unstable = {}
        for _, block, _, a, b, v in reversed(kept):
            into = self.stable if block <= last - 10 else self.unstable
            into[a] = into.get(a, 0) - v
            into[b] = into.get(b, 0) + v
        self.last = last

    def served(self):
        keys = {*self.stable, *self.unstable}
        return {k: n for k in keys if (n := self.stable.get(k, 0) + self.unstable.get(k, 0))}


def batches(seed):
    rnd, ord_, top = random.Random(seed), 0, 20
    out = []
    for _ in range(3):
        log = []
        for block in range(max(0, top - 9), top + rnd.randrange(3, 9)):
            for idx in range(rnd.randrange(0, 4)):
                log.append((ord_ := ord_ + 1, block, idx, f"0x{rnd.randrange(9):040x}", f"0x{rnd.randrange(9):040x}", rnd.randrange(1, 99)))
            top = block
        log.append((ord_ := ord_ + 1, top, 9999999, "0x0", "0x0", 0))
        out.append(log)
    return out


SCHEMA = "ord long, block long, log_idx long, from_addr string, to_addr string, amount long"


def test_state_and_replayed_batches(spark, tmp_path):
    model, state = Model(), LedgerState(spark, str(tmp_path / "store"))
    for i, log in enumerate(batches(7)):
        model.apply(log)
        df = spark.createDataFrame(log, SCHEMA)
        assert state.apply(df, i) and not state.apply(df, i)
        state = LedgerState(spark, str(tmp_path / "store"))  # a restart loses nothing
        assert {r.addr: r.amount for r in state.served().collect()} == model.served()
        asked = state.lookup(spark.createDataFrame([("0x" + "f" * 40,)], "addr string")).first()
        assert (asked.amount, asked.till_block, asked.success) == (0, model.last, True)
    state.vacuum()
    assert state.served().count() == len(model.served())


def test_stream_with_restart(spark, tmp_path):
    model, folder = Model(), tmp_path / "in"
    state = LedgerState(spark, str(tmp_path / "store"))
    for log in batches(8):
        model.apply(log)
        spark.createDataFrame(log, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
        run(stream, state, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    assert {r.addr: r.amount for r in state.served().collect()} == model.served()


def test_changes_apply(spark):
    kv = lambda d: spark.createDataFrame(list(d.items()), "addr string, amount long")
    old, new = kv({"a": 1, "b": 2, "c": 3}), kv({"b": 5, "c": 3, "d": 4})
    diff = ledger.changes(old, new)
    assert {r.addr: (r.amount, r.op) for r in diff.collect()} == {"a": (0, "delete"), "b": (5, "update"), "d": (4, "insert")}
    after, wrong = ledger.apply_changes(old, diff)
    assert {r.addr: r.amount for r in after.collect()} == {"b": 5, "c": 3, "d": 4} and tuple(wrong.first()) == (0, 0)
    assert tuple(ledger.apply_changes(new, diff)[1].first()) == (1, 1)


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    row = (5, "0xab", 1, "0x1", "0x2", str(2**255), "2024-01-01")
    files.append_log(spark.createDataFrame([row], files.LOG_SCHEMA).unionByName(files.heartbeat(spark, 5)).coalesce(1), path)
    got = files.read_log(spark, path).orderBy("ord").collect()
    assert tuple(got[0])[:-1] == row and got[1].log_idx == 9999999
    (tmp_path / "bad").write_text("5\tx\tnot a number\n")
    with pytest.raises(Exception):
        files.read_log(spark, str(tmp_path / "bad")).collect()


def test_balance_files(spark, tmp_path):
    df = spark.createDataFrame([("0xa", "5", 5), ("0xb", "70", 70), ("0xc", "70", 70)], "addr string, balance string, k int").withColumn("_key", F.lpad(F.col("k").cast("string"), 9, "0"))
    files.write_balances(df, str(tmp_path / "b"), 100, 3)
    text = next((tmp_path / "b").glob("part-*")).read_text().split("\n")
    assert text[:4] == ["100 3 3", "0xb 70", "0xc 70", "0xa 5"]
    header, back = files.read_balances(spark, str(tmp_path / "b"))
    assert header == (100, 3, 3) and back.count() == 3 and files.initial_last_block(header) == 110


def test_perf_log(spark, tmp_path):
    (tmp_path / "p.txt").write_text("noise\nfind: size = 100000, batchSize = 1, time = 20.0 us\ninsert: size = 5, batchSize = 10, time = 0.5 us\n")
    got = {r.operation: r for r in files.read_perf_log(spark, str(tmp_path / "p.txt")).collect()}
    assert got["find"].per_second == 50000 and got["insert"].batch == 10


def test_scanner(spark, tmp_path):
    assert scanner.next_chunk(100, 0, 5000) == 200 and scanner.next_chunk(4000, 0, 5000) == 5000 and scanner.next_chunk(3200, 2, 5000) == 100
    assert scanner.resume_from(None, 5) == 5 and scanner.resume_from(100, 5) == 90

    def flaky(a, b):
        if b - a > 10:
            raise OSError
        return [(i,) for i in range(a, b + 1)]

    assert scanner.fetch_range(flaky, 0, 99)[0] <= 10
    spark.dataSource.register(scanner.block_source(lambda a, b: [(i,) for i in range(a, b + 1) if i % 50 == 0], lambda: 450, "block long"))
    q = spark.readStream.format("blocks").load().writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.sql("select max(block) from scanned").first()[0] == 450:
                break
    finally:
        q.stop()
    assert [r.block for r in spark.table("scanned").orderBy("block").collect()] == list(range(0, 451, 50))


def test_nest_and_virtual(spark):
    log = spark.createDataFrame([(1, "t", 1, "a", "b", 5), (1, "t", 0, "a", "c", 6)], "block long, tx_hash string, log_idx long, from_addr string, to_addr string, amount long")
    assert list(ledger.nest(log).first().events) == [0, 1]
    assert files.generated(spark, 5, lambda i: [(i * i).alias("x")]).agg(F.sum("x")).first()[0] == 30
