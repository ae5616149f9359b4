"""Byte-level BPE (operator 1): encoding by length-bucketed padded matrices, and decoding.

Unique pieces are grouped by length into padded matrices of token ids. In each round every row merges its
leftmost pair of least rank: pair ranks come from a hashed table, only the two pairs beside the merge are looked
up again, and rows that have no pair left are compacted away. A few very long pieces, for which that would be
quadratic, run the same rounds over one row with least ranks kept by block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, columns, steps

NONE = np.int32(2**31 - 1)
LONG = 4096  # bytes of a piece from which on blocks of ranks are used
CELLS = 2_000_000  # of a matrix


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a file of `base64(token) rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined bytes, in an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = [((ranks[t[:i]] << 32) | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([k for k, _ in found], dtype=np.uint64)
        values = np.array([r for _, r in found], dtype=np.int32)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] == np.uint64(2**64 - 1)]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is none; ids below 0 are padding."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = NONE
        return out


class BytePairs:
    """Encoder and decoder of one vocabulary. Bytes that are no token of their own can't be encoded: an error."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table = PairTable(ranks)
        self.packed = {t: np.int32(r).tobytes() for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.tokens = {r: t for t, r in ranks.items()}

    def encode_pieces(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each piece, as bytes; a piece that is a token as it stands is that token."""
        out: list[bytes | None] = list(map(self.packed.get, parts))
        todo = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(parts[i]))
        start = 0
        while start < len(todo):
            n = len(parts[todo[start]])
            if n == 0:
                out[todo[start]] = b""
                start += 1
            elif n > LONG:
                out[todo[start]] = self._long(parts[todo[start]]).tobytes()
                start += 1
            else:  # a bucket: pieces of up to half as many bytes again
                end, width = start, n + n // 2
                while end < len(todo) and len(parts[todo[end]]) <= min(width, LONG) and (end - start) * width <= CELLS:
                    end += 1
                for i, ids in zip(todo[start:end], self._bucket([parts[i] for i in todo[start:end]]), strict=True):
                    out[i] = ids
                start = end
        return out  # type: ignore[return-value]

    def _bucket(self, parts: list[bytes]) -> list[bytes]:
        size = np.array([len(p) for p in parts])
        width = int(size.max())
        ids = np.full((len(parts), width + 1), -1, dtype=np.int32)  # a column of padding ends each row
        ids[np.arange(width + 1) < size[:, None]] = self.single[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        rank = np.full((len(parts), width + 1), NONE, dtype=np.int32)
        rank[:, :width] = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(parts), width)
        row, out = np.arange(len(parts)), [None] * len(parts)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            live = best != NONE
            if not live.all():
                for i in np.flatnonzero(~live):
                    out[row[i]] = ids[i, : size[i]].tobytes()
                row, ids, rank, at, best, size = row[live], ids[live], rank[live], at[live], best[live], size[live]
                if not len(row):
                    break
                width = int(size.max())
                ids, rank = np.ascontiguousarray(ids[:, : width + 1]), np.ascontiguousarray(rank[:, : width + 1])
            k, cols = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            source = cols + (cols > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            rank[:, :-1] = np.take_along_axis(rank, source, axis=1)
            size = size - 1
            ids[k, at] = best
            rank[k, at] = self.table(best, ids[k, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table(ids[left, at[left] - 1], best[left])
        return out  # type: ignore[return-value]

    def _long(self, part: bytes) -> np.ndarray:
        n, width = len(part), max(32, int(len(part) ** 0.5))
        ids = self.single[np.frombuffer(part, dtype=np.uint8)].copy()
        rank = np.full(-(-n // width) * width, NONE, dtype=np.int32)
        rank[: n - 1] = self.table(ids[:-1], ids[1:])
        grid = rank.reshape(-1, width)
        least = grid.min(axis=1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def set_rank(i: int, value: int) -> None:
            rank[i] = value
            least[i // width] = grid[i // width].min()

        while True:
            block = int(least.argmin())
            if least[block] == NONE:
                break
            i = block * width + int(grid[block].argmin())
            gone = after[i]
            ids[i] = rank[i]
            after[i] = after[gone]
            if after[gone] < n:
                before[after[gone]] = i
            set_rank(gone, NONE)
            set_rank(i, int(self.table(ids[i : i + 1], ids[after[i] : after[i] + 1])[0]) if after[i] < n else NONE)
            if before[i] >= 0:
                set_rank(before[i], int(self.table(ids[before[i] : before[i] + 1], ids[i : i + 1])[0]))
            ids[gone] = -1
        return ids[ids >= 0]

    def encode_parts(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; equal pattern matches are merged once."""
        find, known = self.pattern.findall, self.packed.get
        split = [[x.encode() for x in find(t)] for t in texts]
        todo = list({p for x in split for p in x if p not in self.packed})
        fresh = dict(zip(todo, self.encode_pieces(todo), strict=True))
        return [b"".join([known(p) or fresh[p] for p in x]) for x in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_coders: dict[tuple[str, str], tuple[BytePairs, Memo]] = {}


def coder(path: str, pattern: str) -> tuple[BytePairs, Memo]:
    """The encoder of a vocabulary file and its memo, once for each Python worker."""
    if (path, pattern) not in _coders:
        own = BytePairs(load_ranks(path), pattern)
        _coders[path, pattern] = own, Memo(own.encode_parts)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (binary: little-endian unsigned 32-bit) of every text. Null text: as empty. Repeated rows: each."""
    docs = columns(docs, id_col, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = coder(path, pattern)
        for part in steps(it, text_col):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(memo(part.column(1)), pa.binary())], [id_col, "ids"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, bytes (binary) of every row of ids. Null ids: as none. An id outside the vocabulary: an error."""
    encoded = columns(encoded, id_col, ids_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = coder(path, pattern)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], [id_col, "bytes"])

    return encoded.mapInArrow(run, f"`{id_col}` {encoded.schema[0].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes what came out, in one pass.

    Null text counts as empty; null and repeated doc_id stay; further columns are ignored; no rows give none."""
    docs = columns(docs, "doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = coder(path, pattern)
        for part in steps(it):
            out = memo(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in out]),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in out]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
