"""Packing (operator 10): token sequences of one window filled by pieces of documents.

Documents are cut into whole windows and a rest. The rests' lengths (a histogram of window - 1 bins, whatever the
corpus) are matched to shallow combinations of one to three lengths that fill a window: non-negative least squares gives each
combination's repeat count, counts are rounded down to what the histogram still holds, and what is left is packed greedily.
The plan only has numbers for (length, rank among equals); ranks come from counts by part, so no task sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, steps, written
from .token_files import library_memo

WINDOW = 1024
#: Depth-three combinations tried for each length: partners at these shares of what is left.
THIRDS = (0.125, 0.25, 0.375, 0.5)
STEPS = 400


def combinations(present: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of up to three present lengths that fill the window: all pairs, and a spread of triples."""
    has = set(present.tolist())
    found = {(a, window - a) for a in has if 2 * a >= window and window - a in has}
    for a in has:
        left = window - a
        for share in THIRDS:
            b = int(left * share)
            for x in range(max(1, b - 2), b + 3):
                if x in has and 0 < left - x and left - x in has:
                    found.add(tuple(sorted((a, x, left - x), reverse=True)))
    return sorted(found, reverse=True)


def least_squares(combos: list[tuple[int, ...]], histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """min |A x - h| over x >= 0 by accelerated projected gradient; A has a combination's lengths in its column."""
    if not combos:
        return np.zeros(0)
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    rows = np.concatenate(combos)
    ones = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step
        ones = np.bincount(cols, np.bincount(rows, ones[cols], len(histogram))[rows], len(combos))
        top = np.linalg.norm(ones)
        ones /= top
    step, x, y, t = 1 / (1.05 * top), np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(steps):
        grad = np.bincount(cols, (np.bincount(rows, y[cols], len(histogram)) - histogram)[rows], len(combos))
        new = np.maximum(0, y - step * grad)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order of their offsets) and how often each is used; uses every piece exactly once.

    histogram: pieces by length, index 0 unused, up to and including window."""
    left = histogram.astype(np.int64).copy()
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    combos = combinations(np.flatnonzero(left), window)
    for combo, x in zip(combos, least_squares(combos, left.astype(float)), strict=True):
        need = {n: combo.count(n) for n in combo}
        if (count := min([int(x), *(int(left[n]) // k for n, k in need.items())])) > 0:
            out.append((combo, count))
            for n, k in need.items():
                left[n] -= k * count
    while left.any():  # best fit, longest first; each turn uses up a length or a pattern's worth of it
        room, combo, use = window, [], left.copy()
        while len(fit := np.flatnonzero(use[: room + 1])):
            n = int(fit[-1])
            combo.append(n)
            use[n] -= 1
            room -= n
        need = {n: combo.count(n) for n in combo}
        count = min(int(left[n]) // k for n, k in need.items())
        out.append((tuple(combo), count))
        for n, k in need.items():
            left[n] -= k * count
    return out


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], window: int = WINDOW) -> None:
        self.by_length: dict[int, list[tuple[int, int, int]]] = {}
        used, base = np.zeros(window + 1, dtype=np.int64), 0
        for combo, count in patterns:
            offset = 0
            for n in combo:
                self.by_length.setdefault(n, []).append((int(used[n]), base, offset))  # first rank, first sequence, offset
                used[n] += count
                offset += n
            base += count
        self.sequences = base
        self.arrays = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for n, v in self.by_length.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for n in np.unique(length):
            mine = length == n
            first, base, at = self.arrays[int(n)]
            k = np.searchsorted(first, rank[mine], side="right") - 1
            sequence[mine], offset[mine] = base[k] + rank[mine] - first[k], at[k]
        return sequence, offset


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, part, rank (among the part's pieces of
    that length), and ids (binary, 32-bit) if asked for. Null text counts as empty; every document has the end id.
    A special token's string in a text gives its id, as the library has it."""
    docs = columns(docs, "doc_id", "text")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long" + ", ids binary" * with_ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, memo, end = TaskContext.get().partitionId(), library_memo(tokenizer_path, 4, True), np.array([end_id], dtype="<u4").tobytes()
        seen = [0] * (window + 1)
        for batch in steps(it):
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, ids in zip(batch.column(0).to_pylist(), memo(batch.column(1)), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    own = ids[4 * start : 4 * (start + window)]
                    n = len(own) // 4
                    for col, v in zip(rows, (doc, start, n, zlib.crc32(own), total, part, seen[n], *[own] * with_ids), strict=True):
                        col.append(v)
                    seen[n] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [c.split()[0] for c in out.split(", ")])

    return docs.mapInArrow(run, out)


def pack(cut_pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces with length, part and rank; part and rank go. The input is read
    three times, so it should be a written table (ranks have to be the same each time)."""
    counts = cut_pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    bases = written(counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in bases.groupBy("length").agg(F.sum("n")).collect():  # at most `window` rows
        histogram[length] = n
    places = Places(plan(histogram, window), window)
    # Bases grow with the parts, so they are never broadcast; a length that most pieces have is a key for each part.
    ranked = cut_pieces.join(bases.select("part", "length", "base").hint("merge"), ["part", "length"])
    keep = [c for c in cut_pieces.columns if c not in ("part", "rank")]
    ranked = ranked.select(*keep, (F.col("base") + F.col("rank")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sequence, offset = places(b["length"].to_numpy(), b["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Encodes, cuts and packs: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    Null text: as empty (one end id). Null or repeated doc_id: kept as they are. No documents: no rows."""
    return pack(written(cut(docs, tokenizer_path, end_id, window, with_ids)), window)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
