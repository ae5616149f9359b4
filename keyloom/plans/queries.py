"""The query catalogue: each query applies library operators to the test tables; where SQL can say the same, it stands
beside it, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import capacity
from ..functions import numbers as N
from ..operators import ledger, oplog, routing
from ..operators.array import AddressedArray, load_histogram, positions, split_address
from ..operators.order import Running, position, running
from ..operators.stored import KeyValueStore, StoredTable
from ..operators.table import KeyedTable, duplicate_keys
from ..sources import files, scanner
from ..sources.folders import work_folder
from ..streaming.ledger_stream import LedgerState
from ..streaming.ledger_stream import run as run_ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS, SALT = 8, "salt"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- keyed tables

def _accounts(s: SparkSession, d: str) -> KeyedTable:
    return KeyedTable(table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")), ["key"])


def _probe(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", (F.col("user_id") * 9).alias("key"))


_FIND = "SELECT event_id, user_id * 9 AS key, c_acctbal AS value, c_custkey IS NOT NULL AS found FROM events LEFT JOIN customer ON c_custkey = user_id * 9"


@query(_FIND)
def find_batch(s, d):
    return _accounts(s, d).find_batch(_probe(s, d))


@query(_FIND)
def find_batch_dedup(s, d):
    return _accounts(s, d).find_batch(_probe(s, d), distinct_first=True)


@query("SELECT event_id, user_id * 9 AS key, coalesce(c_acctbal, -1.0) AS value, c_custkey IS NOT NULL AS found FROM events LEFT JOIN customer ON c_custkey = user_id * 9")
def find_batch_default(s, d):
    return _accounts(s, d).find_batch(_probe(s, d), default={"value": -1.0})


@query("SELECT c_custkey AS key, c_acctbal AS value, true AS found FROM customer WHERE c_custkey = 7")
def find_one(s, d):
    return _accounts(s, d).find({"key": 7})


def _even(s: SparkSession, d: str) -> KeyedTable:
    own = table(s, d, "customer").where("c_custkey % 2 = 0")
    return KeyedTable(own.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")), ["key"])


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"))


_WIN = "w AS (SELECT o_custkey AS key, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey), m AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_WIN} SELECT coalesce(w.key, m.key) AS key, CASE WHEN w.key IS NOT NULL THEN w.value ELSE m.value END AS value FROM m FULL JOIN w ON m.key = w.key")
def insert_batch(s, d):
    return _even(s, d).insert_batch(_orders(s, d), "ord")[0].df


@query("""WITH b AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS key, o_totalprice AS value FROM orders),
w AS (SELECT key, max_by(value, ord) AS value FROM b WHERE key IS NOT NULL GROUP BY key), m AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(w.key, m.key) AS key, CASE WHEN w.key IS NOT NULL THEN w.value ELSE m.value END AS value FROM m FULL JOIN w ON m.key = w.key""")
def insert_with_dummies(s, d):
    """A batch of which every fourth row is a dummy: a null key."""
    batch = _orders(s, d).withColumn("key", F.when(F.col("ord") % 4 != 0, F.col("key")))
    return _even(s, d).insert_batch(batch, "ord")[0].df


@query("SELECT o_orderkey AS ord, o_custkey AS key, o_totalprice AS value, c_custkey IS NOT NULL AS existed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def insert_batch_flags(s, d):
    return _even(s, d).insert_batch(_orders(s, d), "ord")[1]


@query("SELECT o_orderkey AS ord, o_custkey AS key, o_totalprice AS value, c_acctbal AS old_value, c_custkey IS NOT NULL AS existed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def swap_batch(s, d):
    return _even(s, d).swap_batch(_orders(s, d), "ord")[1]


def _final(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"))


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def erase_batch(s, d):
    return _accounts(s, d).erase_batch(_final(s, d))[0].df


@query("SELECT o_orderkey AS ord, o_custkey AS key, c_custkey IS NOT NULL AS existed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 WHERE o_orderstatus = 'F'")
def erase_batch_flags(s, d):
    return _even(s, d).erase_batch(_final(s, d))[1]


@query(f"WITH {_WIN} SELECT m.key, CASE WHEN w.key IS NOT NULL THEN w.value ELSE m.value END AS value FROM m LEFT JOIN w ON m.key = w.key")
def update_if_present(s, d):
    return _even(s, d).update_batch(_orders(s, d), "ord")[0].df


@query(f"WITH {_WIN} SELECT key, value FROM w")
def load_last_wins(s, d):
    return KeyedTable.load(_orders(s, d), ["key"], ["value"], duplicates="last", order="ord").df


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def load_duplicates(s, d):
    return duplicate_keys(_orders(s, d), ["key"])


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 5 <> 0")
def load_without_dummies(s, d):
    own = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return KeyedTable.load(own, ["key"], is_dummy=F.col("key") % 5 == 0).df


@query("SELECT coalesce(o.k, c.c_custkey) AS key, CASE WHEN o.k IS NOT NULL THEN o.v ELSE c.c_acctbal END AS value FROM customer c FULL JOIN (SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) o ON o.k = c.c_custkey")
def build_from_batches(s, d):
    return KeyedTable.builder(["key"]).add(_accounts(s, d).df).add(_orders(s, d), "ord").finalize().df


@query("SELECT (SELECT count(*) FROM customer) AS held, CAST(0 AS BIGINT) AS held_empty, (SELECT count(*) FROM orders) AS room, true AS sized")
def table_facts(s, d):
    """Load, an empty table with a capacity, and whether the size is known."""
    own = _accounts(s, d)
    none = KeyedTable.empty(s, "key bigint, value double", ["key"], capacity=table(s, d, "orders").count())
    return s.createDataFrame([(own.count(), none.count(), none.capacity, own.size_in_bytes() > 0)], "held bigint, held_empty bigint, room bigint, sized boolean")


@query("SELECT n_regionkey AS region, encode(n_name) AS name, n_nationkey AS value, r_name IS NOT NULL AS found FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey < 20")
def find_by_two_keys(s, d):
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").cast("binary").alias("name"), F.col("n_nationkey").alias("value"))
    own = KeyedTable(n.where("value < 20").withColumn("hit", F.lit(1)), ["region", "name"], ["hit"])
    return own.find_batch(n).drop("hit")


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT -1, 0.5")
def insert_one(s, d):
    return _even(s, d).insert({"key": -1}, {"value": 0.5})[0].df


@query("SELECT c_custkey AS key, CASE WHEN c_custkey = 4 THEN 0.5 ELSE c_acctbal END AS value FROM customer WHERE c_custkey % 2 = 0")
def update_one(s, d):
    return _even(s, d).update({"key": 4}, {"value": 0.5})[0].df


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0 AND c_custkey <> 4")
def erase_one(s, d):
    return _even(s, d).erase({"key": 4})[0].df


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1")
def load_from_slots(s, d):
    slots = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), (F.col("c_custkey") % 3 == 0).alias("valid"), (F.col("c_custkey") % 2 == 0).alias("dummy"))
    return KeyedTable.from_slots(slots, ["key"], ["value"], "valid", "dummy").df


# ---- operation logs

def _ops(s: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "purchase", "U").when(F.col("event_type") == "error", "E").otherwise("F")
    return table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("key"), op.alias("op"), "value")


_OPS = "o AS (SELECT event_id AS ord, user_id AS key, value, CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'U' WHEN 'error' THEN 'E' ELSE 'F' END AS op FROM events)"


@query(f"""WITH {_OPS}, p AS (SELECT *, last_value(CASE WHEN op IN ('I', 'E') THEN op END IGNORE NULLS) OVER w AS st,
  coalesce(sum(CASE WHEN op = 'E' THEN 1 ELSE 0 END) OVER w, 0) AS era FROM o WINDOW w AS (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ord, key, op, value, coalesce(st = 'I', false) AS found, CASE WHEN st = 'I' THEN last_value(CASE WHEN op = 'I' OR (op = 'U' AND st = 'I') THEN value END IGNORE NULLS)
  OVER (PARTITION BY key, era ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS found_value FROM p""")
def oplog_replay(s, d):
    return oplog.replay(_ops(s, d))


@query(f"""WITH {_OPS}, e AS (SELECT key, max(ord) AS e FROM o WHERE op = 'E' GROUP BY key),
a AS (SELECT o.* FROM o LEFT JOIN e ON o.key = e.key WHERE op IN ('I', 'U') AND (e.e IS NULL OR ord > e.e)),
f AS (SELECT key, min(ord) AS f FROM a WHERE op = 'I' GROUP BY key)
SELECT a.key, max_by(value, ord) AS value FROM a JOIN f ON a.key = f.key WHERE ord >= f GROUP BY a.key""")
def oplog_final_state(s, d):
    return oplog.final_state(_ops(s, d))


# ---- shards and routing

_HASH = "CAST(('0x' || substr(sha256('salt' || CAST({} AS VARCHAR)), 1, 15)) AS BIGINT)"
_WIDTH = -(-(1 << 60) // SHARDS)


def _sharded(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key"))
    return own.withColumn("shard", B.shard_of(B.salted_hash(F.col("key"), SALT), SHARDS))


_SHARDED = f"s AS (SELECT o_orderkey AS ord, o_custkey AS key, CAST({_HASH.format('o_custkey')} // {_WIDTH} AS INTEGER) AS shard FROM orders)"


@query(f"WITH {_SHARDED} SELECT shard, count(DISTINCT key) AS keys FROM s GROUP BY shard")
def shard_histogram(s, d):
    return routing.shard_loads(_sharded(s, d), "shard", "key")


@query(f"""WITH {_SHARDED}, k AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY key) AS slot FROM (SELECT DISTINCT shard, key FROM s)),
w AS (SELECT max(slot) AS width FROM k), g AS (SELECT a.range AS shard, b.range AS slot FROM range({SHARDS}) a, w, LATERAL (SELECT unnest(range(1, width + 1)) AS range) b)
SELECT g.shard, g.slot, k.key FROM g LEFT JOIN k ON g.shard = k.shard AND g.slot = k.slot""")
def shard_padded(s, d):
    return routing.pad_shards(_sharded(s, d), "shard", "key", SHARDS)


_BATCH = 1000
_BOUND = capacity.max_per_shard(_BATCH, SHARDS)
#: (batch, shards) and (slots of a bucket, ways) that bounds are made for.
_LOADS, _BUCKETS = ((100, 2), (1000, 8), (1000, 15), (4000, 4)), ((64, 2), (128, 4), (256, 3))


def _tails(name: str, cases: str) -> str:
    """CTEs: the chance that more than k of n fall into one of w shards, summed up from the far end."""
    lp = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(1.0 / w) + (n - k) * ln(1 - 1.0 / w)"
    return (
        f"{name}c AS ({cases}), {name}k AS (SELECT *, unnest(range(n + 1)) AS k FROM {name}c), "
        f"{name} AS (SELECT *, coalesce(sum(exp({lp})) OVER (PARTITION BY id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail FROM {name}k)"
    )


_LOAD_CASES = " UNION ALL ".join(f"SELECT {i} AS id, {n} AS n, {w} AS w" for i, (n, w) in enumerate(_LOADS))
_BOUND_SQL = f"(WITH {_tails('b', f'SELECT 0 AS id, {_BATCH} AS n, {SHARDS} AS w')} SELECT CAST(min(k) AS INTEGER) FROM b WHERE k >= ceil(n / w) AND tail < pow(2, -40))"


@query(f"""WITH k AS (SELECT DISTINCT user_id AS key FROM events), s AS (SELECT CAST({_HASH.format('key')} // {_WIDTH} AS INTEGER) AS shard FROM k), m AS (SELECT {_BOUND_SQL} AS bound)
SELECT shard, count(*) AS load, any_value(bound) AS bound, count(*) > any_value(bound) AS over FROM s, m GROUP BY shard""")
def shard_overflow(s, d):
    own = table(s, d, "events").select(F.col("user_id").alias("key")).distinct()
    loads = own.groupBy(B.shard_of(B.salted_hash(F.col("key"), SALT), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("load"))
    return loads.withColumns({"bound": F.lit(_BOUND), "over": F.col("load") > _BOUND})


@query(f"WITH {_tails('t', _LOAD_CASES)} SELECT CAST(n AS BIGINT) AS batch, CAST(w AS BIGINT) AS shards, CAST(min(k) AS BIGINT) AS most FROM t WHERE k >= ceil(n / w) AND tail < pow(2, -40) GROUP BY n, w")
def shard_bounds(s, d):
    return s.createDataFrame([(n, w, capacity.max_per_shard(n, w)) for n, w in _LOADS], "batch bigint, shards bigint, most bigint")


_BUCKET_CASES = " UNION ALL ".join(f"SELECT {i} * 1000 + e AS id, {b} AS b, e, ({b} - e) * {w} AS n, {w} AS w FROM (SELECT unnest(range(1, {b})) AS e)" for i, (b, w) in enumerate(_BUCKETS))


@query(f"WITH {_tails('t', _BUCKET_CASES)}, x AS (SELECT b, w, e, max(CASE WHEN k = b THEN tail ELSE 0 END) AS tail FROM t GROUP BY b, w, e) SELECT CAST(b AS BIGINT) AS slots, CAST(w AS BIGINT) AS ways, CAST(b - min(e) AS BIGINT) AS filled FROM x WHERE tail < pow(2, -60) GROUP BY b, w")
def bucket_bounds(s, d):
    return s.createDataFrame([(b, w, capacity.real_per_bucket(b, w)) for b, w in _BUCKETS], "slots bigint, ways bigint, filled bigint")


@query("""WITH f AS (SELECT unnest(range(2, 9)) AS f), c AS (SELECT a.f AS n, [a.f] AS own FROM f a UNION ALL SELECT a.f * b.f, [a.f, b.f] FROM f a JOIN f b ON a.f <= b.f
UNION ALL SELECT a.f * b.f * c.f, [a.f, b.f, c.f] FROM f a JOIN f b ON a.f <= b.f JOIN f c ON b.f <= c.f),
r AS (SELECT n, own, row_number() OVER (PARTITION BY n ORDER BY len(own), CASE WHEN n = 24 THEN -1 ELSE 1 END * (list_max(own) - list_min(own)), own) AS r FROM c WHERE n <= 64 AND NOT (n = 24 AND list_max(own) > 8))
SELECT CAST(n AS BIGINT) AS shards, array_to_string(own, 'x') AS factors FROM r WHERE r = 1""")
def shard_factors(s, d):
    def of(n: int) -> list[int]:
        try:
            return capacity.shard_factors(n)
        except ValueError:
            return []

    return s.createDataFrame([(n, "x".join(map(str, of(n)))) for n in range(1, 100) if of(n)], "shards bigint, factors string")


@query(f"SELECT p_partkey AS key, h1 % 97 AS first, h2 % 97 AS second, h3 AS rest FROM (SELECT p_partkey, {', '.join(f'CAST((chr(48) || chr(120) || substr(sha256(concat(chr(115), chr(97), chr(108), chr(116), p_partkey)), {1 + 12 * i}, 12)) AS BIGINT) AS h{i + 1}' for i in range(3))} FROM part)")
def two_choice_positions(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("key"), B.two_positions(F.col("p_partkey"), SALT, 97).alias("x")).select("key", "x.first", "x.second", "x.rest")


@query("SELECT p_partkey AS ord, p_size AS size, row_number() OVER (ORDER BY p_partkey) AS pos FROM part WHERE p_size > 25")
def compact(s, d):
    own = table(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("size"))
    return routing.compact(own, "ord", F.col("size") > 25)


@query("SELECT p_partkey AS ord, p_size AS size, CAST(coalesce(sum(CAST(p_size > 25 AS INT)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM part")
def compact_prefix_sum(s, d):
    own = table(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("size"))
    return routing.prefix_sum(own, "ord", F.col("size") > 25)


@query("""WITH i AS (SELECT s_suppkey AS item, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier),
t AS (SELECT p_partkey AS slot, p_size > 45 AS marked, CASE WHEN p_size > 45 THEN row_number() OVER (PARTITION BY p_size > 45 ORDER BY p_partkey) END AS r FROM part)
SELECT slot, marked, item FROM t LEFT JOIN i ON t.r = i.r""")
def distribute(s, d):
    slots = table(s, d, "part").select(F.col("p_partkey").alias("slot"), (F.col("p_size") > 45).alias("marked"))
    return routing.distribute(table(s, d, "supplier").select(F.col("s_suppkey").alias("item")), "item", slots, "slot", F.col("marked"))


@query("""WITH r AS (SELECT o_orderkey AS ord, o_orderstatus AS mark, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS round FROM orders)
SELECT ord, mark, round, row_number() OVER (ORDER BY round, mark) AS pos FROM r""")
def interleave(s, d):
    return routing.interleave(table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("mark")), "mark", "ord")


@query("SELECT o_orderkey AS tag, o_orderkey % 5 AS bucket, o_orderkey // 5 AS rest FROM orders")
def bucketize_tag(s, d):
    bucket, rest = routing.by_tag(F.col("o_orderkey"), 5)
    return table(s, d, "orders").select(F.col("o_orderkey").alias("tag"), bucket.alias("bucket"), rest.alias("rest"))


@query("SELECT p_partkey AS key, p_size AS size, CAST((p_size > 10)::INT + (p_size > 20)::INT + (p_size > 40)::INT AS INTEGER) AS bucket FROM part")
def bucketize_pivots(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), routing.by_pivots(F.col("p_size"), (10, 20, 40)).alias("bucket"))


@query("""WITH r AS (SELECT s_suppkey AS key, CAST(s_suppkey % 2 AS INTEGER) AS side, row_number() OVER (PARTITION BY s_suppkey % 2 ORDER BY s_suppkey) AS slot FROM supplier),
g AS (SELECT CAST(a.range AS BIGINT) AS side, b.range + 1 AS slot FROM range(2) a, range(1000) b) SELECT g.side, g.slot, r.key FROM g LEFT JOIN r ON g.side = r.side AND g.slot = r.slot""")
def split_two_ways(s, d):
    own, right = table(s, d, "supplier").select(F.col("s_suppkey").alias("key")), F.col("key") % 2 == 1
    fuller = own.groupBy(right).count().agg(F.max("count")).first()[0] or 0
    return routing.split_two_ways(own, "key", right, max(1000, fuller))


@query("SELECT p_partkey AS key, p_retailprice AS price, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def sort_with_payload(s, d):
    own = table(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"))
    ranked = routing.sorted_rank(own.withColumn("down", -F.col("price")), "down", "key")
    return ranked.drop("down")


@query("""SELECT event_id AS ord, user_id AS key, first_value(value) OVER w AS value, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def propagate_duplicates(s, d):
    return routing.propagate(table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("key"), "value"), "key", "ord", "value")


@query("SELECT c_custkey AS ord, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer")
def recover_order(s, d):
    return position(routing.shuffled(table(s, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name")), 1), "ord")


@query("SELECT s_suppkey AS ord, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE -1 END AS moved, CASE WHEN s_nationkey > 12 THEN s_suppkey ELSE CAST(s_nationkey AS BIGINT) END AS a, CASE WHEN s_nationkey > 12 THEN CAST(s_nationkey AS BIGINT) ELSE s_suppkey END AS b FROM supplier")
def move_and_swap(s, d):
    nation = F.col("s_nationkey")
    a, b = routing.swapped(nation > 12, nation.cast("long"), F.col("s_suppkey"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("ord"), routing.choose(nation % 2 == 0, nation, F.lit(-1)).alias("moved"), a.alias("a"), b.alias("b"))


@query("SELECT c_custkey AS key, encode(c_name) < encode(c_mktsegment) AS less, encode(c_name) = encode(c_mktsegment) AS same FROM customer")
def compare_bytes(s, d):
    a, b = F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary")
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), (a < b).alias("less"), (a == b).alias("same"))


@query("SELECT p_partkey FROM part")
def shuffle(s, d):
    return routing.shuffled(table(s, d, "part").select("p_partkey"), 3)


@query(f"WITH {_SHARDED} SELECT shard, count(*) AS rows, CAST(1 AS BIGINT) AS tasks FROM s GROUP BY shard")
def route_to_shards(s, d):
    """Each shard's rows, and in how many tasks they are after routing."""
    routed = routing.route(_sharded(s, d), "shard", SHARDS).withColumn("task", F.spark_partition_id())
    return routed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("task").alias("tasks"))


@query(f"WITH {_SHARDED} SELECT key, ord, shard FROM s")
def routed_rows(s, d):
    return routing.route(_sharded(s, d), "shard", SHARDS).select("key", "ord", "shard")


@query("SELECT s_suppkey AS key, array_to_string(list_sort([s_suppkey % 7, s_suppkey % 5, s_suppkey % 3, s_suppkey % 11]), ',') AS items FROM supplier")
def sort_small_arrays(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("key"), F.array_join(F.array_sort(F.array(k % 7, k % 5, k % 3, k % 11)), ",").alias("items"))


@query("SELECT side, count(*) AS slots, count(key) AS filled FROM (SELECT o_orderkey AS key, o_orderkey % 3 AS side FROM orders) GROUP BY side")
def bucket_counts(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3).alias("side"))
    return routing.check_capacity(rows, "side", 1_000_000_000).groupBy("side").agg(F.count(F.lit(1)).alias("slots"), F.count("key").alias("filled"))


# ---- addressed arrays

_DEFAULT = 31


def _cells(s: SparkSession, d: str) -> int:
    """The greatest address of all requests, plus one."""
    top = [table(s, d, t).agg(F.max(c)).first()[0] for t, c in (("orders", "o_custkey"), ("events", "user_id"))]
    return 1 + max((x for x in top if x is not None), default=-1)


def _writes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("addr"), F.col("o_orderkey").alias("value"))


def _array(s: SparkSession, d: str) -> AddressedArray:
    return AddressedArray.filled(s, _cells(s, d), _DEFAULT).write_batch(_writes(s, d), "ord")


def _requests(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("addr"))


_FIRST = "w AS (SELECT o_custkey AS addr, min(o_orderkey) AS value FROM orders GROUP BY o_custkey)"
_ALL = "n AS (SELECT coalesce(greatest((SELECT max(o_custkey) FROM orders), (SELECT max(user_id) FROM events)), -1) + 1 AS n), c AS (SELECT unnest(range(n)) AS addr FROM n)"


@query(f"WITH {_FIRST}, {_ALL} SELECT c.addr, coalesce(value, {_DEFAULT}) AS value FROM c LEFT JOIN w ON c.addr = w.addr")
def array_read_default(s, d):
    return _array(s, d).dense()


@query(f"""WITH {_FIRST}, {_ALL}, t AS (SELECT DISTINCT user_id AS addr FROM events)
SELECT c.addr, CASE WHEN t.addr IS NOT NULL THEN coalesce(value, {_DEFAULT}) + 1 ELSE coalesce(value, {_DEFAULT}) END AS value
FROM c LEFT JOIN w ON c.addr = w.addr LEFT JOIN t ON c.addr = t.addr""")
def array_batch_access_first_wins(s, d):
    return _array(s, d).access_batch(_requests(s, d), "ord", lambda v: v + 1)[0].dense()


@query(f"WITH {_FIRST} SELECT event_id AS ord, user_id AS addr, coalesce(w.value, {_DEFAULT}) AS value FROM events LEFT JOIN w ON user_id = addr")
def array_batch_access_results(s, d):
    return _array(s, d).access_batch(_requests(s, d), "ord", lambda v: v + 1)[1]


@query(f"WITH {_FIRST} SELECT addr, value * 2 AS value FROM w WHERE value % 2 = 0 UNION ALL SELECT addr, value FROM w WHERE value % 2 <> 0")
def array_transform_batch(s, d):
    own = _array(s, d)
    double = lambda got: got.where("value % 2 = 0").withColumn("new", F.col("value") * 2)
    return own.transform_batch(own.df.select("addr", F.col("addr").alias("ord")), "ord", double)[0].df


@query("WITH k AS (SELECT o_custkey AS addr, min_by(o_orderkey, o_orderkey) AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT addr, value FROM k")
def array_batch_write_kept(s, d):
    requests = table(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("addr"), F.col("o_orderkey").alias("value"), "o_orderstatus")
    return AddressedArray.filled(s, _cells(s, d), _DEFAULT).write_batch(requests, "ord", keep=F.col("o_orderstatus") != "F").df


@query(f"WITH {_FIRST} SELECT addr, value + 1 AS value FROM w WHERE (value + 1) % 3 <> 0")
def array_update_or_remove(s, d):
    return _array(s, d).update_or_remove(_writes(s, d).drop("value"), "ord", lambda v: v + 1, lambda v: v % 3 != 0).df


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS addr, c_name AS value FROM customer")
def array_from_records(s, d):
    own = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("value"))
    return AddressedArray.from_records(own, own.count(), "c_custkey").df


@query(f"WITH n AS (SELECT count(*) AS n FROM customer), u AS (SELECT unnest(range(n)) AS uid, n FROM n) SELECT uid, {_HASH.format('uid')} % n AS position FROM u")
def array_positions(s, d):
    own = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("value"))
    return positions(AddressedArray.from_records(own, own.count(), "c_custkey"), SALT)


@query("SELECT o_orderkey AS addr, o_orderkey % 8 AS slot, (o_orderkey // 8) % 8 AS slot1, (o_orderkey // 64) % 8 AS slot2, o_orderkey // 512 AS rest FROM orders")
def array_address_split(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("addr"), *split_address(F.col("o_orderkey")))


@query("SELECT load, count(*) AS buckets FROM (SELECT o_custkey, count(*) AS load FROM orders GROUP BY o_custkey) GROUP BY load")
def stash_load_histogram(s, d):
    return load_histogram(table(s, d, "orders"), "o_custkey")


#: Leaves of trees that every part's path is followed in, besides one that is just large enough for all keys.
_TREES = (1, 2, 3, 5, 6, 1000, 1024)


@query(f"""WITH s AS (SELECT unnest({list(_TREES)} || [(SELECT CAST(coalesce(max(p_partkey), 0) + 1 AS INTEGER) FROM part)]) AS size),
p AS (SELECT p_partkey AS key, CAST(size AS BIGINT) AS size, p_partkey % size AS path, CAST(ceil(log2(size)) AS INTEGER) AS last FROM part, s),
l AS (SELECT *, unnest(range(last + 1))::INTEGER AS level FROM p),
q AS (SELECT *, CASE WHEN last = 0 THEN 0 ELSE CAST(1 AS BIGINT) << (last - 1) END AS half FROM l)
SELECT key, size, level, (CAST(1 AS BIGINT) << level) - 1 + path % (CAST(1 AS BIGINT) << level)
  - CASE WHEN level = last AND path >= half THEN (CAST(1 AS BIGINT) << last) - size ELSE 0 END AS node
FROM q WHERE level < last OR path >= half OR path + half < size""")
def tree_path_nodes(s, d):
    parts = table(s, d, "part").select(F.col("p_partkey").alias("key"))
    sizes = [*_TREES, (parts.agg(F.max("key")).first()[0] or 0) + 1]
    # A part gives dozens of rows, and its table is one or two splits: dealt out first.
    dealt = parts.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "key")
    own = dealt.select("key", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("size"))
    return N.tree_node_rows(own.withColumn("path", F.col("key") % F.col("size")), "key", "size")


@query("SELECT l_orderkey AS a, l_partkey AS b, CASE WHEN l_orderkey = l_partkey THEN 64 ELSE CAST(bit_count((xor(l_orderkey, l_partkey) & (-xor(l_orderkey, l_partkey))) - 1) AS INTEGER) END AS suffix FROM lineitem")
def common_suffix_len(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), N.common_suffix_length(F.col("l_orderkey"), F.col("l_partkey")).alias("suffix"))


@query("""WITH w AS (SELECT CAST(greatest(16, ceil(log2(coalesce(max(p_partkey), 0) + 1))) AS INTEGER) AS w FROM part)
SELECT p_partkey AS key, CAST(list_sum(list_transform(range(w), lambda i: ((p_partkey >> i::INT) & 1) << (w - 1 - i)::INT)) AS BIGINT) AS reversed FROM part, w""")
def reverse_bits(s, d):
    parts = table(s, d, "part")
    width = max(16, (parts.agg(F.max("p_partkey")).first()[0] or 0).bit_length())
    return parts.select(F.col("p_partkey").alias("key"), N.reverse_bits(F.col("p_partkey"), width).alias("reversed"))


@query("SELECT p_size AS x, CAST(ceil(log2(p_size)) AS INTEGER) AS up, CAST(floor(log2(p_size)) AS INTEGER) AS down, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS power, CAST(ceil(p_size / 7.0) AS BIGINT) AS sevenths FROM (SELECT DISTINCT p_size FROM part)")
def integer_logs(s, d):
    x = F.col("x")
    own = table(s, d, "part").select(F.col("p_size").alias("x")).distinct()
    return own.select("x", N.ceil_log2(x).alias("up"), N.floor_log2(x).alias("down"), N.next_power_of_two(x).alias("power"), N.div_round_up(x, 7).alias("sevenths"))


# ---- ledger

def _transfers(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    account = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return rows.select(F.expr("o_orderkey div 8").alias("block"), account("c", "o_custkey").alias("from_addr"), account("s", "l_suppkey").alias("to_addr"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"))


_TRANSFERS = "t AS (SELECT o_orderkey // 8 AS block, 'c' || o_custkey AS from_addr, 's' || l_suppkey AS to_addr, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_SIDES = "x AS (SELECT block, from_addr AS addr, -amount AS amount FROM t UNION ALL SELECT block, to_addr, amount FROM t)"
_BAL = f"{_TRANSFERS}, {_SIDES}, b AS (SELECT addr, CAST(sum(amount) AS BIGINT) AS amount FROM x GROUP BY addr)"


@query(f"WITH {_BAL} SELECT addr, amount FROM b WHERE amount <> 0")
def ledger_fold(s, d):
    return ledger.fold(_transfers(s, d)).where("amount <> 0")


@query(f"WITH {_BAL} SELECT addr, amount FROM b WHERE amount <> 0 ORDER BY amount DESC, addr LIMIT 100")
def ledger_top(s, d):
    return ledger.top(ledger.fold(_transfers(s, d)).where("amount <> 0"), 100)


def _log(s: SparkSession, d: str) -> DataFrame:
    key = "o_orderkey"
    return table(s, d, "orders").select(F.col(key).alias("ord"), F.expr(f"{key} div 8 - CASE WHEN ({key} div 64) % 5 = 0 THEN 6 ELSE 0 END").alias("block"), F.expr(f"{key} % 8").alias("log_idx"))


_LOG = "t AS (SELECT o_orderkey AS ord, o_orderkey // 8 - CASE WHEN (o_orderkey // 64) % 5 = 0 THEN 6 ELSE 0 END AS block, o_orderkey % 8 AS log_idx FROM orders)"


@query(f"WITH {_LOG}, m AS (SELECT *, min({{'b': block, 'i': log_idx}}) OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM t) SELECT ord, block, log_idx FROM m WHERE {{'b': block, 'i': log_idx}} < m")
def ledger_dedup_last_wins(s, d):
    return ledger.dedup_last_wins(_log(s, d))


@query(f"WITH {_LOG}, m AS (SELECT *, max({{'b': block, 'i': log_idx}}) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t) SELECT ord, block, log_idx FROM m WHERE {{'b': block, 'i': log_idx}} > {{'b': 3::BIGINT, 'i': 2::BIGINT}} AND (m IS NULL OR {{'b': block, 'i': log_idx}} > m)")
def ledger_dedup_first_wins(s, d):
    return ledger.dedup_first_wins(_log(s, d), (3, 2))


@query(f"WITH {_TRANSFERS}, r AS (SELECT *, (SELECT max(block) FROM t) AS last FROM t WHERE block > 40 - 10) SELECT block <= last - 10 AS stable, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM r GROUP BY 1")
def ledger_finality_split(s, d):
    rows = ledger.not_final(_transfers(s, d), 40)
    last = rows.agg(F.max("block")).first()[0]
    stable, unstable = ledger.split_final(rows, last)
    both = stable.withColumn("stable", F.lit(True)).unionByName(unstable.withColumn("stable", F.lit(False)))
    return both.groupBy("stable").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


_CUT = "(block % 3 = 0)"
_CHANGES = f"""{_TRANSFERS}, {_SIDES}, o AS (SELECT addr, CAST(sum(amount) AS BIGINT) AS amount FROM x WHERE {_CUT} GROUP BY addr HAVING sum(amount) <> 0),
n AS (SELECT addr, CAST(sum(amount) AS BIGINT) AS amount FROM x GROUP BY addr HAVING sum(amount) <> 0 AND addr NOT LIKE '%7')"""


def _before_after(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = _transfers(s, d)
    return ledger.fold(log.where(_CUT)).where("amount <> 0"), ledger.fold(log).where("amount <> 0 AND addr NOT LIKE '%7'")


@query(f"""WITH {_CHANGES} SELECT coalesce(o.addr, n.addr) AS addr, coalesce(n.amount, 0) AS amount, CASE WHEN coalesce(n.amount, 0) = 0 THEN 'delete' WHEN coalesce(o.amount, 0) <> 0 THEN 'update' ELSE 'insert' END AS op
FROM o FULL JOIN n ON o.addr = n.addr WHERE coalesce(o.amount, 0) <> coalesce(n.amount, 0)""")
def ledger_cdc(s, d):
    return ledger.changes(*_before_after(s, d))


@query(f"WITH {_CHANGES} SELECT addr, amount FROM n")
def ledger_apply_changes(s, d):
    old, new = _before_after(s, d)
    return ledger.apply_changes(old, ledger.changes(old, new))[0]


@query(f"WITH {_TRANSFERS}, {_SIDES} SELECT addr, CAST(sum(amount) AS BIGINT) AS amount FROM x WHERE block % 3 <> 1 GROUP BY addr HAVING sum(amount) <> 0")
def ledger_apply_delta(s, d):
    log = _transfers(s, d)
    return ledger.apply_delta(ledger.fold(log.where("block % 3 = 0")).where("amount <> 0"), ledger.fold(log.where("block % 3 = 2")))


@query(f"WITH {_TRANSFERS}, {_SIDES} SELECT addr, CAST(sum(CASE WHEN block % 4 = 0 THEN amount WHEN block % 4 = 1 THEN -amount WHEN block % 4 = 2 THEN amount ELSE 0 END) AS BIGINT) AS amount FROM x GROUP BY addr HAVING sum(CASE WHEN block % 4 = 0 THEN amount WHEN block % 4 = 1 THEN -amount WHEN block % 4 = 2 THEN amount ELSE 0 END) <> 0")
def ledger_unstable_retract(s, d):
    log = _transfers(s, d)
    return ledger.served_delta(*(ledger.fold(log.where(f"block % 4 = {i}")) for i in range(3)))


@query(f"WITH {_BAL} SELECT event_id AS nonce, 'c' || (user_id * 9) AS addr, coalesce(amount, 0) AS amount, CAST(1234 AS BIGINT) AS till_block, true AS success FROM events LEFT JOIN b ON b.addr = 'c' || (user_id * 9)")
def balance_lookup(s, d):
    asks = table(s, d, "events").select(F.col("event_id").alias("nonce"), F.concat(F.lit("c"), (F.col("user_id") * 9).cast("string")).alias("addr"))
    return ledger.lookup(asks, ledger.fold(_transfers(s, d)), 1234)


@query("SELECT c_custkey AS key, '0x' || lpad(lower(to_hex(c_custkey)), 40, '0') AS addr FROM customer")
def address_normalise(s, d):
    short = F.concat(F.lit("0x"), B.to_hex(F.col("c_custkey")))
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), B.normalize_address(short).alias("addr"))


@query("SELECT c_custkey AS key, lower(to_hex(encode(c_name))) AS digits, c_name AS back, base64(encode(c_name)) AS packed FROM customer")
def hex_and_base64(s, d):
    digits = B.to_hex(F.col("c_name").cast("binary"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), digits.alias("digits"), B.from_hex(digits).cast("string").alias("back"), F.base64(F.col("c_name").cast("binary")).alias("packed"))


@query("SELECT n_nationkey AS key, reverse(n_name) AS swapped FROM nation")
def swap_bytes(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("key"), B.swap_bytes(F.col("n_name").cast("binary")).cast("string").alias("swapped"))


@query("SELECT o_orderkey AS key, strftime(to_timestamp(o_orderkey * 1000)::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def epoch_times(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), B.epoch_to_iso(F.col("o_orderkey") * 1000).alias("at"))


_M = 1 << 32


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Transfers whose amounts have low, middle and high limbs."""
    v = F.col("amount")
    names = dict(zip(N.LIMBS, (v % _M, v * 7 % _M, v % 1000, v * 3 % _M, F.lit(0).cast("long"), v % 77, v * 5 % _M, v * 11 % _M), strict=True))
    return _transfers(s, d).select("from_addr", "to_addr", *[c.cast("long").alias(n) for n, c in names.items()])


def _chain() -> str:
    """The carry chain in DuckDB: one more CTE for each limb."""
    steps, before = [], "s"
    for i in range(8):
        carry = "0" if i == 0 else f"k{i - 1}"
        x = f"(l{i} + {carry})"
        r = f"((({x} % {_M}) + {_M}) % {_M})"
        steps.append(f"c{i} AS (SELECT *, {r} AS r{i}, ({x} - {r}) // {_M} AS k{i} FROM {before})")
        before = f"c{i}"
    return ", ".join(steps)


_WIDE = f"amount % {_M} AS l0, amount * 7 % {_M} AS l1, amount % 1000 AS l2, amount * 3 % {_M} AS l3, 0 AS l4, amount % 77 AS l5, amount * 5 % {_M} AS l6, amount * 11 % {_M} AS l7"
_SUMS = ", ".join(f"CAST(sum(g * l{i}) AS BIGINT) AS l{i}" for i in range(8))


@query(f"WITH {_TRANSFERS}, w AS (SELECT from_addr, to_addr, {_WIDE} FROM t), y AS (SELECT from_addr AS addr, -1 AS g, * FROM w UNION ALL SELECT to_addr, 1, * FROM w), s AS (SELECT addr, {_SUMS} FROM y GROUP BY addr), {_chain()} SELECT addr, {', '.join(f'CAST(r{i} AS BIGINT) AS l{i}' for i in range(8))} FROM c7")
def u256_fold(s, d):
    return ledger.fold(_wide(s, d), ledger.U256)


@query("SELECT c_custkey AS key, concat('1', c_custkey, repeat('7', 68)) AS text, concat('-1', c_custkey, repeat('3', 60)) AS below FROM customer")
def u256_text(s, d):
    """Numbers of about 250 bits, and negative ones through their complement, to limbs and back."""
    key = F.col("c_custkey").cast("string")
    own = table(s, d, "customer").select(F.col("c_custkey").alias("key"), N.parse_u256(F.concat(F.lit("1"), key, F.lit("7" * 68))).alias("x"), N.parse_u256(F.concat(F.lit("-1"), key, F.lit("3" * 60))).alias("y"))
    return own.select("key", N.render_u256("x").alias("text"), N.render_signed("y").alias("below"))


@query("""SELECT o_orderkey // 8 AS block, CAST(o_custkey AS VARCHAR) AS tx, to_json(map_from_entries(list({'k': CAST(o_orderkey AS VARCHAR),
  'v': {'from_addr': o_orderstatus, 'to_addr': o_orderpriority, 'amount': CAST(round(o_totalprice) AS BIGINT)}} ORDER BY o_orderkey))) AS events FROM orders GROUP BY 1, 2""")
def tx_nest(s, d):
    own = table(s, d, "orders").select(
        F.expr("o_orderkey div 8").alias("block"), F.col("o_custkey").cast("string").alias("tx_hash"), F.col("o_orderkey").alias("log_idx"),
        F.col("o_orderstatus").alias("from_addr"), F.col("o_orderpriority").alias("to_addr"), F.round("o_totalprice").cast("long").alias("amount"),
    )
    return ledger.nest(own).select("block", F.col("tx_hash").alias("tx"), F.to_json("events").alias("events"))


@query("SELECT c_custkey, true AS same FROM customer")
def encrypt_roundtrip(s, d):
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    name = F.col("c_name").cast("binary")
    return table(s, d, "customer").select("c_custkey", (B.decrypt(B.encrypt(name, key), key) == name).alias("same"))


@query("SELECT c_custkey AS key, c_name AS back, octet_length(encode(c_name)) AS bytes, false AS plain FROM customer")
def ctr_roundtrip(s, d):
    """AES-CTR there and back, with a nonce for each row."""
    key, nonce = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), F.unhex(F.lpad(F.hex("c_custkey"), 24, "0"))
    name = F.col("c_name").cast("binary")
    own = table(s, d, "customer").select(F.col("c_custkey").alias("key"), name.alias("name"), nonce.alias("nonce")).withColumn("sealed", B.ctr(F.col("name"), key, F.col("nonce")))
    return own.select("key", B.ctr(F.col("sealed"), key, F.col("nonce")).cast("string").alias("back"), F.octet_length("sealed").cast("long").alias("bytes"), (F.col("sealed") == F.col("name")).alias("plain"))


# ---- tables on disk

def _stored(s: SparkSession, d: str) -> StoredTable:
    return StoredTable.create(work_folder(s), _even(s, d).df, ["key"])


@query(f"WITH {_WIN}, e AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F') SELECT coalesce(w.key, m.key) AS key, CASE WHEN w.key IS NOT NULL THEN w.value ELSE m.value END AS value FROM m FULL JOIN w ON m.key = w.key WHERE coalesce(w.key, m.key) NOT IN (SELECT key FROM e)")
def stored_changes(s, d):
    """Upserts, then erasures, as runs on top of the base."""
    own = _stored(s, d)
    own.insert_batch(_orders(s, d), "ord")
    own.erase_batch(_final(s, d))
    return own.rows()


@query(f"WITH {_WIN}, a AS (SELECT coalesce(w.key, m.key) AS key, CASE WHEN w.key IS NOT NULL THEN w.value ELSE m.value END AS value FROM m FULL JOIN w ON m.key = w.key) SELECT event_id, user_id * 9 AS key, a.value, a.key IS NOT NULL AS found FROM events LEFT JOIN a ON a.key = user_id * 9")
def stored_find(s, d):
    """A probe after a batch that was folded into the base."""
    own = _stored(s, d)
    own.insert_batch(_orders(s, d), "ord")
    own.compact()
    return own.find_batch(_probe(s, d))


@query("SELECT o_orderkey AS ord, o_custkey AS key, o_totalprice AS value, c_custkey IS NOT NULL AS existed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def stored_flags(s, d):
    return _stored(s, d).insert_batch(_orders(s, d), "ord")


@query("SELECT c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE CAST(c_custkey AS VARCHAR) END AS value, row_number() OVER (ORDER BY c_name) AS pos FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 = 0")
def key_value_store(s, d):
    """Puts, then one atomic batch of puts and deletes, then the pairs in order."""
    own, store = table(s, d, "customer"), KeyValueStore(s, work_folder(s))
    store.write_batch(own.select(F.col("c_name").alias("key"), F.col("c_custkey").cast("string").alias("value")))
    store.write_batch(own.where("c_custkey % 5 = 0").select(F.col("c_name").alias("key"), F.lit("new").alias("value")), own.where("c_custkey % 3 = 0").select(F.col("c_name").alias("key")))
    return routing.sorted_rank(store.items(), "key", name="pos")


@query("SELECT c_custkey AS key, c_name AS name, CAST(2 AS BIGINT) AS version FROM customer")
def snapshots(s, d):
    """The second version of a table, as the pointer names it."""
    store, own = files.Snapshots(s, work_folder(s)), table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    store.publish({"names": own.limit(0)})
    store.publish({"names": own}, note="all")
    return store.read("names").withColumn("version", F.lit(store.meta()["version"]).cast("long"))


# ---- sources and sinks

def _log_lines(s: SparkSession, d: str) -> DataFrame:
    """Transfers with text amounts, as a log file has them; part: the append that a line comes with."""
    rows = table(s, d, "orders").withColumn("part", F.col("o_orderkey") % 3)
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.expr("o_orderkey div 8").alias("block"), F.concat(F.lit("0x"), text("o_orderkey")).alias("tx_hash"), (F.col("o_orderkey") % 8).alias("log_idx"),
        F.concat(F.lit("0x"), text("o_custkey")).alias("from_addr"), F.lit("0x1").alias("to_addr"), text("o_orderkey").alias("value"), F.lit("0").alias("ts"), "part", F.col("o_orderkey").alias("o"),
    )


def _log_read(s: SparkSession, d: str) -> DataFrame:
    folder, lines = work_folder(s), _log_lines(s, d)
    for part in (0, 1, 2):
        files.append_log(lines.where(F.col("part") == part), folder, "o")
    return files.read_log(s, folder)


_LINES = "t AS (SELECT o_orderkey // 8 AS block, o_orderkey % 8 AS log_idx, '0x' || o_custkey AS from_addr, CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) AS pos FROM orders)"


@query(f"WITH {_LINES} SELECT block, log_idx, from_addr, value, pos FROM t")
def log_source(s, d):
    """A log that was appended to in three parts of several files each, in order."""
    return position(_log_read(s, d), "ord").select("block", "log_idx", "from_addr", "value", "pos")


@query(f"WITH {_LINES}, m AS (SELECT *, min({{'b': block, 'i': log_idx}}) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM t) SELECT block, log_idx, value FROM m WHERE {{'b': block, 'i': log_idx}} < m")
def log_source_dedup(s, d):
    """Which lines of that log count depends on their order across parts."""
    return ledger.dedup_last_wins(_log_read(s, d)).select("block", "log_idx", "value")


def _held(s: SparkSession, d: str) -> DataFrame:
    own = ledger.fold(_transfers(s, d)).where("amount > 0")
    return own.select("addr", F.col("amount").cast("string").alias("balance"), F.lpad(F.col("amount").cast("string"), 20, "0").alias("_key"))


def _file_lines(s: SparkSession, folder: str) -> DataFrame:
    rows = s.read.text(folder).withColumn("_id", F.monotonically_increasing_id())
    return position(rows, "_id", "pos", start=0).select("pos", F.col("value").alias("line"))


def _file_sql(order: str) -> str:
    return f"WITH {_BAL}, h AS (SELECT * FROM b WHERE amount > 0) SELECT CAST(0 AS BIGINT) AS pos, '77 3 ' || (SELECT count(*) FROM h) AS line UNION ALL SELECT row_number() OVER (ORDER BY {order}), addr || ' ' || amount FROM h"


@query(_file_sql("amount DESC, addr || ' ' || amount"))
def balance_file(s, d):
    """Lines of a balance file, the greatest balance first."""
    folder = work_folder(s)
    files.write_balances(_held(s, d), folder, 77, 3)
    return _file_lines(s, folder)


@query(_file_sql("addr || ' ' || amount"))
def balance_file_by_address(s, d):
    """Lines of a balance file in the order of a store's keys."""
    folder = work_folder(s)
    files.write_balances(_held(s, d), folder, 77, 3, by="addr")
    return _file_lines(s, folder)


@query(f"WITH {_BAL} SELECT addr, CAST(amount AS VARCHAR) AS balance, CAST(77 AS BIGINT) AS block, CAST(87 AS BIGINT) AS first_last, (SELECT count(*) FROM b WHERE amount > 0) AS n FROM b WHERE amount > 0")
def balance_file_read(s, d):
    folder = work_folder(s)
    files.write_balances(_held(s, d), folder, 77, 3)
    head, rows = files.read_balances(s, folder)
    return rows.withColumns({"block": F.lit(head[0]).cast("long"), "first_last": F.lit(files.initial_last_block(head)).cast("long"), "n": F.lit(head[2]).cast("long")})


@query("SELECT 'find' AS operation, p_partkey AS size, CAST(p_size AS BIGINT) AS batch, p_retailprice AS micros, 1e6 / p_retailprice AS per_second FROM part")
def performance_log(s, d):
    folder = work_folder(s)
    table(s, d, "part").select(F.format_string("find: size = %d, batchSize = %d, time = %s us", "p_partkey", "p_size", F.col("p_retailprice").cast("string"))).union(s.createDataFrame([("noise",)], "x string")).write.text(folder)
    return files.read_perf_log(s, folder)


@query("SELECT '0x' || lpad(lower(to_hex(c_custkey)), 40, '0') AS key FROM customer WHERE c_custkey % 2 = 0")
def store_accounts(s, d):
    """Keys of a store that are addresses; the others are metadata."""
    key = F.when(F.col("c_custkey") % 2 == 0, B.normalize_address(F.concat(F.lit("0x"), B.to_hex(F.col("c_custkey"))))).otherwise(F.col("c_name"))
    return files.accounts(table(s, d, "customer").select(key.alias("key")))


@query("SELECT i AS key, i * i AS square FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS i)")
def virtual_source(s, d):
    return files.generated(s, table(s, d, "customer").count(), lambda i: [i.alias("key"), (i * i).alias("square")])


@query("WITH p AS (SELECT unnest([0, 50, 100, 400, 1600, 6400, 10000]) AS size, unnest([0, 1]) AS dummy), q AS (SELECT DISTINCT a.size, b.hits FROM p a, (SELECT unnest([0, 3]) AS hits) b WHERE a.size IS NOT NULL) SELECT CAST(size AS BIGINT) AS size, CAST(hits AS BIGINT) AS hits, CAST(greatest(100, least(5000, CASE WHEN hits > 0 THEN 100 ELSE 2 * size END)) AS BIGINT) AS next FROM q")
def scan_chunks(s, d):
    """How many blocks a scanner takes next."""
    return s.createDataFrame([(n, h, scanner.next_chunk(n, h, 5000)) for n in (0, 50, 100, 400, 1600, 6400, 10000) for h in (0, 3)], "size bigint, hits bigint, next bigint")


@query("SELECT CAST(last AS BIGINT) AS last, CAST(first AS BIGINT) AS first, CAST(CASE WHEN last IS NULL THEN first ELSE greatest(first, last - 10) END AS BIGINT) AS start FROM (SELECT unnest([NULL, 0, 5, 100, 4000]) AS last), (SELECT unnest([0, 95]) AS first)")
def scan_resume(s, d):
    """Where a scanner goes on after a restart."""
    return s.createDataFrame([(x, y, scanner.resume_from(x, y)) for x in (None, 0, 5, 100, 4000) for y in (0, 95)], "last bigint, first bigint, start bigint")


@query("SELECT c_custkey AS key, c_custkey AS number, CAST(NULL AS BIGINT) AS none FROM customer")
def metadata_casts(s, d):
    """Integers kept as text, and text that is none."""
    text = F.col("c_custkey").cast("string")
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), text.cast("long").alias("number"), F.concat(text, F.lit("x")).try_cast("long").alias("none"))


# ---- the ledger as a state

_ACCOUNT = "'0x' || lpad(CAST({} AS VARCHAR), 40, '0')"
_MOVES = f"t AS (SELECT o_orderkey // 8 AS block, o_orderkey % 8 AS log_idx, {_ACCOUNT.format('o_custkey')} AS from_addr, {_ACCOUNT.format('1000000 + o_orderkey % 97')} AS to_addr, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders)"
_PARTS = "z AS (SELECT max(block) AS top FROM t), y AS (SELECT i, top * i // 3 AS upto, greatest(top * (i - 1) // 3 - 20, -1) AS above FROM z, (SELECT unnest([1, 2, 3]) AS i))"


def _ledger_state(s: SparkSession, d: str) -> LedgerState:
    """A stream of three micro-batches, started again for each; each sends the last 20 blocks of the one before again."""
    account = lambda c: F.concat(F.lit("0x"), F.lpad(c.cast("string"), 40, "0"))
    log = table(s, d, "orders").select(
        F.expr("o_orderkey div 8").alias("block"), (F.col("o_orderkey") % 8).cast("long").alias("log_idx"),
        account(F.col("o_custkey")).alias("from_addr"), account(F.col("o_orderkey") % 97 + 1_000_000).alias("to_addr"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"),
    )
    schema = "block bigint, log_idx bigint, from_addr string, to_addr string, amount bigint, ord bigint"
    top, folder, marks, state = log.agg(F.max("block")).first()[0] or 0, work_folder(s), work_folder(s), LedgerState(s, work_folder(s))
    before = -1
    for i in (1, 2, 3):
        upto = top * i // 3
        part = log.where((F.col("block") <= upto) & (F.col("block") > max(before - 20, -1)))
        closing = s.createDataFrame([(upto, 9_999_999, "0x0", "0x0", 0)], "block bigint, log_idx bigint, from_addr string, to_addr string, amount bigint")
        # ord: by append, then place. As many files as the part's size asks for: what is in one file is one task's.
        own = part.unionByName(closing).withColumn("ord", F.lit(i << 56) + F.col("block") * 10_000_000 + F.col("log_idx"))
        own.repartition("block").write.mode("append").parquet(folder)
        # The stream goes on from its checkpoint: all files of the part are one micro-batch.
        run_ledger(s.readStream.schema(schema).parquet(folder), state, marks, every=None).awaitTermination()
        before = upto
    return state


@query(f"WITH {_MOVES}, {_SIDES} SELECT addr, CAST(sum(amount) AS BIGINT) AS amount FROM x GROUP BY addr HAVING sum(amount) <> 0")
def ledger_stream_served(s, d):
    return _ledger_state(s, d).served()


@query(f"""WITH {_MOVES}, {_SIDES}, {_PARTS}, f AS (SELECT addr FROM x WHERE block <= (SELECT top FROM z) - 10 GROUP BY addr HAVING sum(amount) <> 0)
SELECT (SELECT top FROM z) AS last_block, CAST(9999999 AS BIGINT) AS last_idx, (SELECT count(*) FROM f) AS records, CAST(floor((SELECT count(*) FROM f) * 1.2) AS BIGINT) AS room,
  (SELECT count(*) FROM t, y WHERE y.i > 1 AND t.block > y.above AND t.block <= y.above + 10) AS late, CAST(2 AS BIGINT) AS batch""")
def ledger_stream_entries(s, d):
    """What is kept with the balances, and the room of the table that serves them."""
    state = _ledger_state(s, d)
    e, room = state.entries(), state.served_table().capacity
    return s.createDataFrame([(e["last_block"], e["last_idx"], e["records"], room, e["late"], e["batch"])], "last_block bigint, last_idx bigint, records bigint, room bigint, late bigint, batch bigint")


@query(f"WITH {_MOVES}, {_SIDES}, b AS (SELECT addr, CAST(sum(amount) AS BIGINT) AS amount FROM x GROUP BY addr) SELECT event_id AS nonce, {_ACCOUNT.format('user_id * 9')} AS addr, coalesce(amount, 0) AS amount, (SELECT max(block) FROM t) AS till_block, true AS success FROM events LEFT JOIN b ON b.addr = {_ACCOUNT.format('user_id * 9')}")
def ledger_stream_lookup(s, d):
    asks = table(s, d, "events").select(F.col("event_id").alias("nonce"), F.concat(F.lit("0x"), F.lpad((F.col("user_id") * 9).cast("string"), 40, "0")).alias("addr"))
    return _ledger_state(s, d).lookup(asks)


@query(f"WITH {_LOG}, l AS (SELECT max_by(block, ord) AS last FROM t) SELECT CAST(b AS BIGINT) AS last_block, last < b AS stale FROM l, (SELECT unnest([0, 5, 100, 1000000000]) AS b)")
def ledger_stale(s, d):
    return s.createDataFrame([(b, ledger.is_stale(_log(s, d), b)) for b in (0, 5, 100, 1_000_000_000)], "last_block bigint, stale boolean")


@query(f"WITH {_CHANGES}, g AS (SELECT addr, amount FROM n UNION ALL SELECT 'zz' || addr, amount FROM n WHERE addr LIKE '%5'), m AS (SELECT coalesce(s.addr, c.addr) AS addr, s.addr AS had, c.op FROM g s FULL JOIN (SELECT coalesce(o.addr, n.addr) AS addr, CASE WHEN n.addr IS NULL THEN 'delete' WHEN o.addr IS NOT NULL THEN 'update' ELSE 'insert' END AS op FROM o FULL JOIN n ON o.addr = n.addr WHERE coalesce(o.amount, 0) <> coalesce(n.amount, 0)) c ON s.addr = c.addr) SELECT count(*) FILTER (WHERE had IS NOT NULL AND op = 'insert') AS inserts, count(*) FILTER (WHERE had IS NULL AND op <> 'insert') AS others FROM m")
def ledger_mismatches(s, d):
    """A change set against a table that has it already: how many of its rows don't fit."""
    old, new = _before_after(s, d)
    more = new.unionByName(new.where("addr LIKE '%5'").withColumn("addr", F.concat(F.lit("zz"), F.col("addr"))))
    return ledger.apply_changes(more, ledger.changes(old, new))[1]


@query(f"WITH {_LOG}, m AS (SELECT ord, min(block) OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least_after, CAST(coalesce(sum(log_idx) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sum_before FROM t) SELECT * FROM m")
def running_values(s, d):
    values = {"least_after": Running("min", F.col("block"), after=True), "sum_before": Running("sum", F.col("log_idx"))}
    return running(_log(s, d), "ord", values).select("ord", "least_after", "sum_before")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers folded to balances, then looked up by a batch of requests."""
    return balance_lookup(spark, sf_dir)
