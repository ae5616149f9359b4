"""N-gram Jaccard join (operator 6) over a count-vector R-tree, with classes of linked documents.

1. Documents with equal shingle sets are one class; only classes are compared.
2. Points. The shingles of a class are hashed into groups, a power of two that is at least half of their number; the groups'
   counts are its point. Points with more groups fold onto fewer by adding up. The summed minima of two points (or
   boxes of points) bound the overlap of the sets from above, and closely, as groups hold one or two shingles.
3. Blocks. Two sets of Jaccard t differ in at most d shingles, d from their sizes. With the shingles hashed into more than d groups
   at least one group is the same in both, so classes that share no group's content are never linked. A group's
   digest and its class are a message; messages are packed into arrays and meet by digest. A digest of up to CROWD classes
   makes their pairs, of which those that the bound of their points leaves are edges: sets that only have a passage in common
   don't connect. A digest of more classes makes no pairs. It hangs its classes on one of them, but only those that need it: a class
   with so few crowded groups (and groups not told) that any linked one also shares another group is left out.
   Connected classes are a block.
   Groups that only hold common shingles (of lines and passages that many texts share, found in a bounded sample) are
   not told: there are a few more groups than needed, so that one with another shingle agrees too. Sets with too
   many of such groups tell them all. So what is common decides about the size of blocks, never about links.
4. A block of up to BLOCK classes and BLOCK_SHINGLES shingles is one task's: a bulk-loaded R-tree over its points (halved along the widest
   coordinate) is searched for every class, and what survives is verified on the sets, unless it is linked already.
5. A larger block is joined tree node by tree node. First the edges that the digests hung up are verified, which finds
   nearly all of its classes' components. Then leaves of up to LEAF points are packed into rows, those of the block's largest component
   apart from the others. Leaves outside that component meet all leaves of the block whose boxes may reach the similarity;
   only points travel. Surviving pairs of different components are verified on the sets: first the best of each two
   components in two leaves, then, with what those joined, all that are left.

Shingles count as their 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, sampled, written
from .fingerprints import _mix
from .graph import components

#: Groups of a point, at least and at most; of a box that is compared with others. Points or boxes of a box.
LEAST, MOST, COARSE, FANOUT = 128, 65_536, 128, 16
#: Classes and shingles of a block that one task compares; points of a leaf of larger ones.
BLOCK, BLOCK_SHINGLES, LEAF = 128, 4_000_000, 256
#: Common shingles: in COMMON_IN or more of about SAMPLE different texts, at most MOST_COMMON of them. A set may have this
#: share of them without telling groups that hold nothing else, if it has about as many groups of those as expected.
SAMPLE, COMMON_IN, MOST_COMMON, COMMON_SHARE = 4000, 4, 100_000, 0.15
#: Messages that a task gathers before it emits them.
GATHER = 1_000_000
#: Classes of a digest that are compared pair by pair.
CROWD = 16
NULL_ID = -(2**63)
_U = np.uint64


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, with A-Z in lower case."""
    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not own:
        return np.empty(0, dtype=_U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=_U, count=len(own))
    width = min(words, len(own))
    n = len(own) - width + 1
    out = np.full(n, width, dtype=_U)
    for i in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


@lru_cache
def bands(percent: int, limit: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band, and its numbers of groups and of groups with nothing but common shingles, or with none,
    that a set may have without telling them.

    A set's partners are in its own band or the next; both tell the groups of either band. Smaller sets than the first
    band's are linked with equal sets only."""
    starts = [percent // (100 - percent)]
    while starts[-1] < limit:
        starts.append(100 * starts[-1] // percent + 1)
    groups, spare = [], []
    for low, after in zip(starts, starts[1:], strict=False):
        differ = 2 * (100 - percent) * (after - 1) // (100 + percent)
        m = 1
        for _ in range(3):
            expected = (differ + 1 + m) * math.exp(-low * (1 - COMMON_SHARE) * percent / 100 / (differ + 1 + m))
            m = int(expected + 3 * math.sqrt(expected)) + 1
        groups.append(differ + 1 + m)
        spare.append(m)
    return np.array(starts[:-1]), np.array(groups), np.array(spare)


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts share, from a sample of bounded size. Any set is right, a good one saves work."""
    some = sampled(docs, F.xxhash64("doc_id"), SAMPLE / max(1, docs.count())).select("text").distinct()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(it):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, words) for t in texts]).view(np.int64))], ["h"])

    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_IN)
    return np.sort(np.array([r.h for r in found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], dtype=np.int64).view(_U))


def digests(sets: list[np.ndarray], percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all groups that the sets tell, and the set of each. common: sorted hashes of common shingles."""
    return told_groups(sets, percent, common)[:2]


def told_groups(sets: list[np.ndarray], percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of all groups that the sets tell, the set of each, and for even and odd bands how many of its told groups
    a set can do without: any linked set shares another one. A digest is even or odd as its band is."""
    starts, groups, spare = bands(percent)
    size = np.array([len(s) for s in sets])
    own = np.searchsorted(starts, size, side="right") - 1
    hashes = np.concatenate(sets) if sets else np.empty(0, dtype=_U)
    at = np.repeat(np.arange(len(sets)), size)
    mixed = _mix(hashes + _U(0x2545F4914F6CDD1D))
    own_sign = np.ones(len(hashes), dtype=bool)
    if common is not None and len(common):
        own_sign = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes
    low, high = (mixed & _U(0xFFFFFFFF)).astype(float), (mixed >> _U(32)).astype(float)
    found, slack = [], np.zeros((2, len(sets)), dtype=np.int64)
    for band in (own, own + 1):
        tells = own >= 0 if band is own else own >= -1
        tells = tells & (size >= starts[np.maximum(band, 0)] * percent // 100) & (size > 0)
        count = np.where(tells, groups[np.maximum(band, 0)], 0)
        first = np.concatenate([[0], np.cumsum(count)])
        mine = tells[at]
        code = first[at[mine]] + ((hashes[mine] >> _U(17)) % count[at[mine]].astype(_U)).astype(np.int64)
        n = int(first[-1])
        filled = np.bincount(code[own_sign[mine]], minlength=n) > 0
        total = np.bincount(code, low[mine], n).astype(_U) + (np.bincount(code, high[mine], n).astype(_U) << _U(20))
        owner = np.repeat(np.arange(len(sets)), count)
        empty = np.bincount(owner[~filled], minlength=len(sets))
        left = spare[np.maximum(band, 0)] - empty
        slack[band & 1, np.arange(len(sets))] = left
        tell = filled | (left < 0)[owner]
        group = (np.arange(n) - first[owner]).astype(_U)
        total = _mix(total + _mix(group * _U(0x9E3779B97F4A7C15) + band[owner].astype(_U) * _U(0xD6E8FEB86659FD93)))
        total = total & ~_U(1) | (band[owner] & 1).astype(_U)
        found.append((total[tell], owner[tell]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), slack


def once(digest: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct messages, in order."""
    order = np.lexsort((node, digest))
    digest, node = digest[order], node[order]
    new = np.ones(len(digest), dtype=bool)
    new[1:] = (digest[1:] != digest[:-1]) | (node[1:] != node[:-1])
    return digest[new], node[new]


def meetings(digest: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all messages of some digests: distinct pairs of nodes (two rows) that share a digest of up to CROWD nodes; and which
    of once()'s messages are of larger ones."""
    digest, node = once(digest, node)
    head = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]])) if len(digest) else np.empty(0, dtype=np.int64)
    size = np.diff(np.concatenate([head, [len(digest)]]))
    pairs = [np.empty((2, 0), dtype=_U)]
    for n in range(2, CROWD + 1):
        some = node[head[size == n][:, None] + np.arange(n)]
        pairs.append(np.stack([some[:, x].ravel() for x in np.triu_indices(n, 1)]))
    return np.unique(np.concatenate(pairs, axis=1), axis=1), np.repeat(size > CROWD, size)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def node_of(key: bytes) -> int:
    """48 bits of a set's key. Sets with the same node come into the same block, no more."""
    return int.from_bytes(key[:6], "little")


def groups_for(size: int) -> int:
    return min(MOST, max(LEAST, 1 << max(0, size // 2 - 1).bit_length()))


def counts(own: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(((own >> _U(40)) % _U(groups)).astype(np.int64), minlength=groups)


def point(own: np.ndarray) -> bytes:
    """The counts of a set's groups, a byte each, or four if one has more than 255 shingles; the last byte says which."""
    v = counts(own, groups_for(len(own)))
    return v.astype("u1").tobytes() + b"\x01" if v.max() < 256 else v.astype("<u4").tobytes() + b"\x04"


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    return v.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def points_of(raw: list[bytes], groups: int | None = None) -> np.ndarray:
    """Points, all with the fewest groups that one of them has, or with `groups`."""
    own = [np.frombuffer(x, dtype="u1" if x[-1] == 1 else "<u4", count=(len(x) - 1) // x[-1]) for x in raw]
    groups = groups or min(map(len, own))
    return np.stack([folded(v, groups) for v in own])


def coarse(raw: bytes) -> bytes:
    """A point with a fourth of its groups, as long as LEAST are left."""
    v = points_of([raw])[0]
    v = folded(v, max(LEAST, len(v) // 4))
    return v.astype("u1").tobytes() + b"\x01" if v.max() < 256 else v.astype("<u4").tobytes() + b"\x04"


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


_SET = {"doc": "long", "row": "long", "n_shingles": "long", "key": "binary", "node": "long", "point": "binary", "place": "int", "slack_even": "long", "slack_odd": "long"}
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(kinds: dict[str, str]) -> tuple[str, pa.Schema]:
    return ", ".join(f"{n} {t}" for n, t in kinds.items()), pa.schema([(n, _TYPES[t]) for n, t in kinds.items()])


def _filled(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch with the columns that there are; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def sets_and_meetings(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In one pass over the texts:

    Of every row doc (null doc_id: the least long), row (a hash of the text), n_shingles, key, node, point; an empty
    set has no key. place: a number that similar sets have in common, more often than not. slack_even, slack_odd: see
    told_groups. These rows only travel along.
    a, b: pairs of nodes that share a digest of up to CROWD nodes; repeats stay. And digest, node of the other digests."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = 8 * parts  # even, as digests and their slots are even or odd together
    common = common_shingles(columns(docs, "doc_id", "text"), words)
    told_kinds, told_schema = _schema({"slot": "long", "digests": "binary", "nodes": "binary", **_SET})
    met_kinds, met_schema = _schema({"a": "long", "b": "long", "digest": "long", **_SET})

    def tell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            digest, node = once(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            slot, rest = digest % _U(slots), digest // _U(slots)
            order = np.argsort(slot, kind="stable")
            slot, rest, node = slot[order], rest[order], node[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]])
            spans = [(int(x), int(y)) for x, y in zip(cut[:-1], cut[1:], strict=True) if y > x]
            rows = [(int(slot[x]), _six(rest[x:y]), _six(node[x:y])) for x, y in spans]
            held.clear()
            return _filled({n: pa.array(c, told_schema.field(n).type) for n, c in zip(("slot", "digests", "nodes"), zip(*rows, strict=True), strict=True)}, told_schema)

        size = 0
        for part, texts in batches(it):
            own = [shingles(t, words) for t in texts]
            keys = [set_key(s) if len(s) else None for s in own]
            nodes = [k and node_of(k) for k in keys]
            digest, owner, slack = told_groups(own, percent, common)
            row = part.column(2)
            doc = part.column(0).fill_null(NULL_ID)
            # by document and text: copies share the text's hash
            dealt = _mix(doc.to_numpy().view(_U) * _U(0x9E3779B97F4A7C15) + row.to_numpy().view(_U)) % _U(slots)
            out = {"slot": dealt.astype(np.int64), "n_shingles": [len(s) for s in own], "key": keys, "node": nodes, "slack_even": slack[0], "slack_odd": slack[1]}
            out |= {"point": [point(s) if len(s) else None for s in own], "place": [int(_mix(s[:1])[0] >> _U(48)) if len(s) else None for s in own]}
            arrays = {n: pa.array(v, told_schema.field(n).type) for n, v in out.items()}
            yield _filled({**arrays, "doc": doc, "row": row}, told_schema)
            if not len(digest):
                continue
            held.append((digest, np.array([n or 0 for n in nodes], dtype=_U)[owner]))
            size += len(digest)
            if size > GATHER:
                yield flush()
                size = 0
        if size:
            yield flush()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, digest, node = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            rest, nodes = once(_of_six(b"".join(digest)), _of_six(b"".join(node)))
            pairs, crowded = meetings(rest, nodes)
            yield _filled({n: pa.array(x.astype(np.int64)) for n, x in zip("ab", pairs, strict=True)}, met_schema)
            if crowded.any():
                whole = rest[crowded] * _U(slots) + _U(slot)
                yield _filled({"digest": pa.array(whole.view(np.int64)), "node": pa.array(nodes[crowded].astype(np.int64))}, met_schema)

        for batch in it:
            is_set = batch["n_shingles"].is_valid()
            rows = batch.filter(is_set)
            if rows.num_rows:
                yield _filled({n: rows[n] for n in _SET}, met_schema)
            told = batch.filter(pc.invert(is_set))
            for s, d, n in zip(*(told[c].to_pylist() for c in ("slot", "digests", "nodes")), strict=True):
                if s != slot and digest:
                    yield from done()
                    digest, node = [], []
                slot = s
                digest.append(d)
                node.append(n)
        if digest:
            yield from done()

    rows = columns(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    told = rows.mapInArrow(tell, told_kinds).repartitionById(parts, (F.col("slot") % parts).cast("int")).sortWithinPartitions("slot")
    met = written(told.mapInArrow(meet, met_kinds))
    return met.where("n_shingles is not null").select(*_SET), met.where("a is not null").select("a", "b"), met.where("digest is not null").select("digest", "node")


def block_edges(reps: DataFrame, pairs: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """a, b: edges between nodes, written and distinct. reps: a row for each class, with node, n_shingles, point and slack."""

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.select(["a", "b"]).filter(pa.array(reachable(b, percent), pa.bool_()))

    def slim(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b["node"], b["n_shingles"], pa.array([coarse(x) for x in b["point"].to_pylist()], pa.binary())], ["node", "n_shingles", "point"])

    points = written(reps.select("node", "n_shingles", "point").mapInArrow(slim, "node long, n_shingles long, point binary"))
    met = pairs.distinct()
    for side in "ab":
        other = points.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", "point")])
        met = met.join(other.hint("merge"), side)
    met = met.where(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
    close = met.select("a", "b", *[f"{c}_{n}" for c in ("n_shingles", "point") for n in "ab"]).mapInArrow(near, "a long, b long")
    # Classes whose crowded groups may be all that they share with a linked one.
    crowded = crowded.withColumn("odd", F.col("digest").bitwiseAND(F.lit(1)) == 1)
    slack = reps.groupBy("node").agg(F.min("slack_even").alias("slack_even"), F.min("slack_odd").alias("slack_odd"))
    needy = crowded.groupBy("node", "odd").agg(F.count(F.lit(1)).alias("n")).join(slack.hint("merge"), "node")
    needy = needy.where(F.col("n") > F.when(F.col("odd"), F.col("slack_odd")).otherwise(F.col("slack_even"))).select("node", "odd")
    hung = written(crowded.join(needy.hint("merge"), ["node", "odd"]).select("digest", F.col("node").alias("b")))
    stars = hung.join(hung.groupBy("digest").agg(F.min("b").alias("a")), "digest").where("a < b").select("a", "b")
    return written(close.unionByName(stars).distinct())


def reachable(b: pa.RecordBatch, percent: int) -> list[bool]:
    """Whether the points of pairs leave enough overlap."""
    bound = [int(points_of(list(x)).min(axis=0).sum()) for x in zip(b["point_a"].to_pylist(), b["point_b"].to_pylist(), strict=True)]
    size = b["n_shingles_a"].to_numpy() + b["n_shingles_b"].to_numpy()
    return ((100 + percent) * np.array(bound, dtype=np.int64) >= percent * size).tolist()


def in_space(points: np.ndarray) -> np.ndarray:
    """An order in which neighbours are near: runs are halved along their widest coordinate, down to FANOUT points."""
    order, todo = np.arange(len(points)), [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a > FANOUT:
            own = points[order[a:b]]
            order[a:b] = order[a:b][np.argsort(own[:, own.var(axis=0).argmax()], kind="stable")]
            middle = a + max(1, (b - a) // (2 * FANOUT)) * FANOUT
            todo += [(a, middle), (middle, b)]
    return order


class Tree:
    """An R-tree over count vectors that are in the order of in_space(): FANOUT points, or boxes, to a box. A box has
    the greatest counts of its points, and the bounds of their sizes."""

    def __init__(self, points: np.ndarray, size: np.ndarray) -> None:
        self.levels = [(points, size, size)]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, size: int, percent: int, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Points (below `before`, if given) that may reach the similarity, and their bounds of the overlap."""
        at = bound = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            if before is not None:
                at = at[at * FANOUT**depth < before]
            at = at[(100 * high[at] >= percent * size) & (percent * low[at] <= 100 * size)]
            bound = np.minimum(top[at], point).sum(axis=1)
            fits = (100 + percent) * bound >= percent * (size + low[at])  # overlap needed: t / (1 + t) of both sizes
            at, bound = at[fits], bound[fits]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at, bound


def link(own: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels: sets linked, directly or by others, have the same."""
    groups = groups_for(max(map(len, own)))
    points = np.stack([counts(s, groups) for s in own]).astype(np.int32)
    order = in_space(points)
    size = np.array([len(own[i]) for i in order])
    points, label = points[order], np.arange(len(own))
    tree = Tree(points, size)
    for q in range(1, len(own)):
        at, bound = tree.search(points[q], int(size[q]), percent, q)
        open_ = label[at] != label[q]
        at, bound = at[open_], bound[open_]
        for p in at[np.argsort(-bound, kind="stable")]:
            if label[p] != label[q] and similar(own[order[p]], own[order[q]], percent):
                label[label == label[q]] = label[p]
    out = np.empty_like(label)
    out[order] = label
    return out


def _numbered(labels: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    return np.array([seen.setdefault(x, len(seen)) for x in labels])


def survivors(ours: tuple, theirs: tuple, percent: int, best: bool) -> list[tuple[int, int]]:
    """Places of pairs from two leaves (points in the order of in_space, sizes, labels) that may be similar and have
    different labels; best: one pair of each two labels, that with the greatest bound."""
    seen: dict[bytes, int] = {}
    tree, mine, other = Tree(theirs[0], theirs[1]), _numbered(ours[2], seen), _numbered(theirs[2], seen)
    out, top = [], {}
    for q in range(len(mine)):
        at, bound = tree.search(ours[0][q], int(ours[1][q]), percent)
        open_ = other[at] != mine[q]
        for p, b in zip(at[open_].tolist(), bound[open_].tolist(), strict=True):
            pair = (min(mine[q], other[p]), max(mine[q], other[p]))
            if not best:
                out.append((q, p))
            elif b > top.get(pair, (-1,))[0]:
                top[pair] = (b, q, p)
    return out or [(q, p) for _, q, p in top.values()]


def _links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of sets_and_meetings, and key, component (the least doc linked), head (a key that linked classes have in common) of classes
    that may be linked with others."""
    all_sets, pairs, crowded = sets_and_meetings(docs, words, percent)
    same = ("node", "n_shingles", "point", "place", "slack_even", "slack_odd")
    reps = written(all_sets.where("key is not null").groupBy("key").agg(F.min("doc").alias("doc"), *[F.any_value(c).alias(c) for c in same]))
    edges = block_edges(reps, pairs, crowded, percent)
    found = written(reps.drop("slack_even", "slack_odd").join(components(edges, clean=True), "node").withColumnRenamed("component", "block"))
    big = (F.count(F.lit(1)) > BLOCK) | (F.sum("n_shingles") > BLOCK_SHINGLES)
    found = written(found.join(found.groupBy("block").agg(F.count(F.lit(1)).alias("n"), big.alias("big")).where("n > 1"), "block"))
    small, parts = found.where("not big"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, small.select("doc", "key", "block"))
    dealt = texts.repartition(parts, "block").sortWithinPartitions("block")
    linked = dealt.mapInArrow(_linker(words, percent), "key binary, component long, head binary")
    large = found.where("big")
    if not large.isEmpty():
        linked = linked.unionByName(_large(docs, large, edges, words, percent))
    return all_sets, written(linked)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc and more) with the texts of its documents; texts are never broadcast."""
    own = columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text")
    return own.join(wanted.hint("merge"), "doc")


def _linker(words: int, percent: int):
    """Rows of a block, together: key, the least doc that it is linked with, and the first key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}

        def done() -> pa.RecordBatch:
            label = link([s for s, _ in own.values()], percent)
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, label, np.array([d for _, d in own.values()], dtype=np.int64))
            keys = list(own)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(least[label]), pa.array([keys[x] for x in label], pa.binary())], ["key", "component", "head"])

        for part, texts in batches(it):
            doc, key, block = (part.column(n).to_pylist() for n in ("doc", "key", "block"))
            for x, text in enumerate(texts):
                if block[x] != at:
                    if own:
                        yield done()
                    at, own = block[x], {}
                s = shingles(text, words)
                if set_key(s) == key[x]:  # else another text of the same doc_id
                    own[key[x]] = (s, doc[x])
        if own:
            yield done()

    return run


def _large(docs: DataFrame, found: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """key, component, head of the classes of large blocks."""
    found = written(found.select("block", "node", "key", "doc", "n_shingles", "point", "place"))

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(it):
            own = [(k, s) for k, t in zip(part.column("key").to_pylist(), texts, strict=True) if set_key(s := shingles(t, words)) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.binary()), pa.array([s.tobytes() for _, s in own], pa.binary())], ["key", "own"])

    own = written(_texts(docs, found.select("doc", "key")).mapInArrow(hashed, "key binary, own binary").groupBy("key").agg(F.any_value("own").alias("own")))

    def both(pairs: DataFrame, table: DataFrame, on: str, *names: str) -> DataFrame:
        for side in "ab":
            other = table.select(F.col(on).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names])
            pairs = pairs.join(other.hint("merge"), side)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                sides = [[np.frombuffer(x, dtype=_U) for x in b[c].to_pylist()] for c in ("own_a", "own_b")]
                yield b.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(*sides, strict=True)], pa.bool_()))

        return written(both(pairs, own, "key", "own").select("a", "b", "own_a", "own_b").mapInArrow(run, "a binary, b binary"))

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sides = [b[c].to_pylist() for c in ("key_a", "key_b")]
            pairs = [sorted(x) for x, y in zip(zip(*sides, strict=True), reachable(b, percent), strict=True) if y]
            yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], pa.binary()) for n in (0, 1)], ["a", "b"])

    hung = both(edges, found, "node", "key", "point", "n_shingles").select("key_a", "key_b", "point_a", "point_b", "n_shingles_a", "n_shingles_b")
    linked = verified(hung.mapInArrow(near, "a binary, b binary").distinct())
    joined = written(components(linked, clean=True))
    for best in (True, False):
        pairs = written(_leaf_pairs(_leaves(found, joined), percent, best).distinct())
        if pairs.isEmpty():  # then there are none at all
            break
        more = verified(pairs)
        if not more.isEmpty():
            linked = linked.unionByName(more)
            joined = written(components(linked, clean=True))  # new pairs are of different components
    label = found.join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", "doc", F.coalesce("component", "key").alias("head"))
    return label.join(label.groupBy("head").agg(F.min("doc").alias("component")), "head").select("key", "component", "head")


_LEAF = "block long, leaf long, main boolean, label binary, low long, high long, top array<int>, keys array<binary>, labels array<binary>, sizes array<long>, points array<binary>"


def _leaves(found: DataFrame, joined: DataFrame) -> DataFrame:
    """Leaves of large blocks: a row for up to about LEAF points. main: they are of the block's largest component;
    label: that of all points, if it is one."""
    own = found.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    largest = own.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    own = written(own.join(largest, "block").withColumn("main", F.col("label") == F.col("largest")).drop("largest"))
    # Points of a leaf have equally many groups (and so are about as large). Classes of one place lie together, in as many
    # leaves as they fill; the others share leaves by ranges of places.
    own = own.withColumn("wide", F.octet_length("point"))
    cells = own.groupBy("block", "main", "wide", "place").agg(F.count(F.lit(1)).alias("cell")).withColumn("full", F.col("cell") > LEAF // 4)
    rest = cells.where("not full").groupBy("block", "main", "wide").agg(F.ceil(F.sum("cell") / (LEAF * 3 // 4)).alias("shared"))
    cells = cells.join(rest, ["block", "main", "wide"], "left")
    split = F.pmod(F.xxhash64("key", "block"), F.ceil(F.col("cell") / LEAF))
    leaf = F.when(F.col("full"), F.xxhash64("wide", "place", split)).otherwise(F.xxhash64("wide", F.expr("place * shared div 65536")))
    own = own.join(cells, ["block", "main", "wide", "place"]).withColumn("leaf", leaf)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            points = points_of([r["point"] for r in rows])
            order = in_space(points)
            mine, size = [rows[i] for i in order], [r["n_shingles"] for r in rows]
            labels = {r["label"] for r in rows}
            out = {"block": at[0], "leaf": at[2], "main": at[1], "label": labels.pop() if len(labels) == 1 else None, "low": min(size), "high": max(size), "top": np.max([folded(p, COARSE) for p in points], axis=0).tolist()}
            out |= {k: [r[c] for r in mine] for k, c in (("keys", "key"), ("labels", "label"), ("sizes", "n_shingles"), ("points", "point"))}
            return pa.RecordBatch.from_pylist([out], schema)

        schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ") for x in _LEAF.split(", "))])
        for b in it:
            for r in b.to_pylist():
                if (now := (r["block"], r["main"], r["leaf"])) != at:
                    if rows:
                        yield done()
                    at, rows = now, []
                rows.append(r)
        if rows:
            yield done()

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.select("block", "main", "leaf", "key", "label", "n_shingles", "point").repartition(parts, "block", "main", "leaf").sortWithinPartitions("block", "main", "leaf")
    return written(dealt.mapInArrow(run, _LEAF))


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}


def _leaf_pairs(leaves: DataFrame, percent: int, best: bool) -> DataFrame:
    """a, b: pairs of keys from two leaves that survive. Leaves of a block's largest component don't meet each other."""
    box = ("main", "label", "low", "high", "top")
    side = lambda n: leaves.select("block", *[F.col(c).alias(f"{c}_{n}") for c in ("leaf", *box)])
    bound = F.aggregate(F.zip_with("top_a", "top_b", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    met = side("a").where("not main_a").join(side("b").hint("merge"), "block").where("(main_b or leaf_a <= leaf_b) and not coalesce(label_a = label_b, false)")
    met = met.where((100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a")) & ((100 + percent) * bound >= percent * (F.col("low_a") + F.col("low_b"))))
    met = written(met.select("block", "leaf_a", "main_a", "leaf_b", "main_b"))
    names = ("keys", "labels", "sizes", "points")
    for n in "ab":
        full = leaves.select("block", *[F.col(c).alias(f"{c}_{n}") for c in ("leaf", "main", *names)])
        met = met.join(full.hint("merge"), ["block", f"leaf_{n}", f"main_{n}"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                groups = points_of([r["points_a"][0], r["points_b"][0]]).shape[1]
                ours, theirs = ((points_of(r[f"points_{n}"], groups), np.array(r[f"sizes_{n}"]), r[f"labels_{n}"]) for n in "ab")
                pairs = [sorted((r["keys_a"][i], r["keys_b"][j])) for i, j in survivors(ours, theirs, percent, best)]
                yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], pa.binary()) for n in (0, 1)], ["a", "b"])

    return met.select(*[f"{c}_{n}" for c in names for n in "ab"]).mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked, itself included) of every row of docs (doc_id, text).

    Two texts link if they share percent of all their distinct shingles of `words` words; shorter texts are one
    shingle. Null text or no word: size 0, linked with nothing. Null doc_id counts as the least of all and comes out as
    null. Rows that repeat a doc_id are compared by their own texts. A text of any length is hashed whole, in memory. No rows give none."""
    out = _classes(docs, words, percent)
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("doc").alias("doc_id"), "n_shingles", null("component").alias("component_id"))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc, row, n_shingles, component, head (null for texts without a word) of every row."""
    all_sets, linked = _links(docs, words, percent)
    alone = all_sets.where("key is not null").groupBy("key").agg(F.min("doc").alias("least"))
    ids = written(alone.join(linked, "key", "left").select("key", F.coalesce("component", "least").alias("component"), F.coalesce("head", "key").alias("head")))
    return all_sets.select("doc", "row", "n_shingles", "key").join(ids, "key", "left").withColumn("component", F.coalesce("component", "doc")).drop("key")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs with one document of each class: that of the least doc_id. All columns stay; texts without
    a word stay. Of rows equal in doc_id and text one stays; of linked rows that share the least doc_id, that whose
    text has the least hash. Two unlinked texts of one doc_id both stay, if it is the least of both."""
    found = _classes(docs, words, percent).where("doc = component")
    kept = found.where("head is null").select("doc", "row", F.lit(1).alias("_kl_copies")).distinct()
    firsts = found.where("head is not null").groupBy("head", "doc").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    kept = written(kept.unionByName(firsts.select("doc", "row", F.col("n").cast("int").alias("_kl_copies"))).select(F.col("doc").alias("_kl_doc"), F.col("row").alias("_kl_row"), "_kl_copies"))
    own = docs.withColumns({"_kl_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_kl_hash": F.xxhash64("text")})
    out = own.join(kept.hint("merge"), (F.col("_kl_id") == F.col("_kl_doc")) & (F.col("_kl_hash") == F.col("_kl_row"))).drop("_kl_id", "_kl_hash", "_kl_doc", "_kl_row")
    if kept.where("_kl_copies > 1").isEmpty():
        return out.drop("_kl_copies")
    return out.where("_kl_copies = 1").unionByName(out.where("_kl_copies > 1").dropDuplicates(["doc_id", "text"])).drop("_kl_copies")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
