"""Document fingerprints (operator 7): bottom-k sketches of shingle hashes.

Shingles are the windows of WIDTH bytes of a text's UTF-8 (a shorter text is one shingle). A sketch keeps the K least
distinct hashes, sorted. Sketches of parts merge into the sketch of the union; two sketches give resemblance,
containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns

K, WIDTH = 128, 12
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def hashes(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all windows, in order."""
    if not raw:
        return np.empty(0, dtype=np.uint64)
    if len(raw) < width:
        return np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), dtype="<u8")
    n, bytes_ = len(raw) - width + 1, np.frombuffer(raw, dtype=np.uint8)
    if width < 8:
        return _mix(sum(bytes_[i : i + n].astype(np.uint64) << np.uint64(8 * i) for i in range(width)) + _A)

    def eight(at: int) -> np.ndarray:
        return np.ndarray((n,), dtype="<u8", buffer=raw, offset=at, strides=(1,))

    out = _mix(eight(0) + _A)
    for at in range(8, width, 8):
        out = _mix(out * _A + eight(min(at, width - 8)))
    return out


def sketch(raw: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k least distinct hashes, sorted; fewer if there are fewer shingles."""
    h, take = hashes(raw, width), 2 * k
    while take < len(h):
        low = np.unique(np.partition(h, take)[:take])
        if len(low) >= k:
            return low[:k]
        take *= 4
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the shared part of all distinct shingles; exact if both sketches are whole. Two empty ones: 1."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the part of a's distinct shingles that b has too. An empty a: 1."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / max(distinct(a, k), 1.0))


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def load(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint of every text (null: empty, an empty sketch)."""
    docs = columns(docs, id_col, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(it, text_col):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([dump(sketch(t.encode("utf-8", "surrogatepass"))) for t in texts])], [id_col, "fingerprint"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows bucket, tail, key, doc_id, text, dealt and sorted so that within each bucket a row's successor comes next.

    Buckets are ranges of doc_id, one for each task; each also gets (tail) the first row of the bucket after it, the last one that of the
    first. Only bounds and first ids, one for each bucket, meet on the driver. Null doc_id sorts first."""
    docs = columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = F.lit([int(x) for x in bounds]) if bounds else F.array().cast("array<bigint>")
    docs = docs.withColumn("bucket", F.size(F.filter(cuts, lambda x: x <= F.col("key"))))
    firsts = {r.bucket: r.first for r in docs.groupBy("bucket").agg(F.min("key").alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    of = lambda d: F.lit([int(d.get(b, 0)) for b in range(len(bounds) + 1)])[F.col("bucket")]
    own = F.struct(F.col("bucket").cast("bigint").alias("bucket"), F.lit(False).alias("tail"))
    copy = F.struct(of(before).cast("bigint").alias("bucket"), F.lit(True).alias("tail"))
    dealt = docs.select(F.explode(F.when(of(firsts) == F.col("key"), F.array(own, copy)).otherwise(F.array(own))).alias("to"), "key", "doc_id", "text")
    return dealt.select("to.bucket", "to.tail", "key", "doc_id", "text").repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", "key", "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text has its last quarter replaced from the start of the next document. Null text: as empty. Equal doc_ids are
    in the order of their texts; a single document is its own next. No rows give none."""
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, rows = None, []  # held: bucket, doc_id, text and sketch of the row before

        def row(doc, text: str, own: np.ndarray, after: str, theirs: np.ndarray) -> tuple:
            n = len(text) // 4
            edited = (text[: len(text) - n] + after[:n]).encode("utf-8", "surrogatepass")
            new = sketch(edited)
            return doc, len(text), hashlib.sha256(edited).hexdigest(), dump(own), dump(new), resemblance(own, new), resemblance(own, theirs)

        for part, texts in batches(it):
            for bucket, tail, doc, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 3)), texts, strict=True):
                if tail and held is None:
                    continue  # a second copy of the first row of the next bucket
                own = sketch(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    rows.append(row(held[1], held[2], held[3], text, own))
                held = None if tail else (bucket, doc, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in out.split(", ")])
                rows = []

    return with_next(docs).mapInArrow(run, out)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
