"""Token files (operator 4): flat unsigned integers, 64-bit document offsets, one pair of files for each part.

Format, below one folder: `ids-PPPPPPPP.bin` has the little-endian unsigned ids (16 bits if the vocabulary fits, else
32) of the part's documents in ascending doc_id order, `ids-PPPPPPPP.off` as many int64 offsets as documents plus one
(ids before each document in the part) followed by as many int64 doc_ids. Parts ascend too; their bases (ids and
documents in all parts before) are prefix sums over the manifest, a Parquet table of one row for each part.

A task writes under a name of its own attempt and then renames, so a task that runs again leaves whole files only.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _ODD, Memo, columns, pieces, shared_dir, steps, written

#: Documents read back in one step.
READ_DOCS = 4096


def open_tokenizer(path: str):
    """The tokenizers library's tokenizer, as it is: the string of a special token in a text gives that token's id."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache
def special_cut(path: str) -> Callable[[str], list[str]]:
    """common.pieces, with each special token of a tokenizer file as a piece of its own: the library cuts there before all
    else, so white space before one is at the end of a text."""
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    cut = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")").split

    def of(text: str) -> list[str]:
        if "<|" not in text:
            return pieces(text)
        return [p for i, x in enumerate(cut(text)) for p in ([" " + x] if i % 2 else pieces(x))]

    return of


_memos: dict[tuple[str, int, bool], Memo] = {}
#: Pieces that the library encodes in one call, with a special token between them.
TOGETHER = 50
SEPARATOR = "<|endoftext|>"


def library_memo(path: str, width: int, blanks: bool) -> Memo:
    """Encodes pieces of text by the tokenizers library to little-endian ids of so many bytes; once for each worker.
    blanks: the pieces are those of common.pieces.

    The library cuts a text at special tokens before all else, so pieces joined by one are encoded as if alone, and
    its id tells them apart. Pieces that may hold a part of such a string themselves are encoded alone."""
    if (path, width, blanks) not in _memos:
        own, kind = open_tokenizer(path), f"<u{width}"
        mark = own.token_to_id(SEPARATOR)

        def make(todo: list[str]) -> list[bytes]:
            out: list[bytes] = []
            rest, odd = todo, {i for i, p in enumerate(todo) if "|" in p and ("<|" in p or "|>" in p)}
            if odd:
                rest = [p for i, p in enumerate(todo) if i not in odd]
            for i in range(0, len(rest), 40 * TOGETHER):
                some = [rest[j : j + TOGETHER] for j in range(i, min(i + 40 * TOGETHER, len(rest)), TOGETHER)]
                for coded in own.encode_batch_fast([SEPARATOR.join(x) for x in some], add_special_tokens=False):
                    ids = np.array(coded.ids, dtype=kind)
                    raw, cut = ids.tobytes(), (np.flatnonzero(ids == mark) * width).tolist()
                    start = 0
                    for end in cut:
                        out.append(raw[start:end])
                        start = end + width
                    out.append(raw[start:])
            for i in sorted(odd):
                out.insert(i, np.array(own.encode(todo[i], add_special_tokens=False).ids, dtype=kind).tobytes())
            return out

        _memos[path, width, blanks] = Memo(make, blanks=blanks, cut=special_cut(path) if blanks else word_pieces, odd=rf"<\||{_ODD}")
    return _memos[path, width, blanks]


def word_pieces(text: str) -> list[str]:
    """For a vocabulary whose pattern drops white space: cut at blanks and line ends."""
    return text.replace("\n", " ").split(" ")


def filesystem(uri: str):
    """pyarrow's file system and path of a URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, width: int = 2, parts: int | None = None) -> DataFrame:
    """Writes the files; gives the manifest: part, file, n_docs, n_ids, doc_base, id_base.

    docs: doc_id, text (null: empty; null doc_id sorts first and is stored as the least int64; equal doc_ids sort by
    text, all are kept). parts: how many at most; by default the session's shuffle partitions. No documents: no files."""
    spark = docs.sparkSession
    fs, path = filesystem(out_dir)
    fs.create_dir(path, recursive=True)
    kind = f"<u{width}"
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = columns(docs, "doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, fs, own = library_memo(tokenizer_path, width, False), *filesystem(out_dir)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=kind).tobytes()
        name, sizes, ids = f"{own}/.{part:08d}-{uuid.uuid4().hex}", [], []
        stream = None
        for batch in steps(it):
            stream = stream or fs.open_output_stream(f"{name}.bin")
            coded = memo(batch.column(1))
            stream.write(b"".join(y for x in coded for y in (x, end)))
            sizes.append(np.array([len(x) // width + 1 for x in coded], dtype="<i8"))
            ids.append(batch.column(0).fill_null(-(2**63)).to_numpy().astype("<i8"))
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.concatenate(sizes)]).cumsum().astype("<i8")
        with fs.open_output_stream(f"{name}.off") as f:
            f.write(offsets.tobytes() + np.concatenate(ids).tobytes())
        for end_ in ("off", "bin"):
            fs.move(f"{name}.{end_}", f"{own}/ids-{part:08d}.{end_}")
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"ids-{part:08d}", "n_docs": len(offsets) - 1, "n_ids": int(offsets[-1])}])

    # One small row for each part: the window that sums them up has no more rows than there are tasks.
    manifest = written(dealt.mapInArrow(run, "part long, file string, n_docs long, n_ids long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    manifest = manifest.withColumns({"doc_base": F.coalesce(F.sum("n_docs").over(before), F.lit(0)), "id_base": F.coalesce(F.sum("n_ids").over(before), F.lit(0))})
    manifest.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def _mapped(fs, path: str, kind: str, start: int = 0, count: int = -1) -> np.ndarray:
    """A file as an array: memory-mapped where it is a local file, else read."""
    from pyarrow import fs as pafs

    size = np.dtype(kind).itemsize
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")[start : None if count < 0 else start + count]
    with fs.open_input_file(path) as f:
        f.seek(start * size)
        return np.frombuffer(f.read(None if count < 0 else count * size), dtype=kind)


def read_tokens(spark: SparkSession, out_dir: str, width: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), and ids (binary, 32-bit) if asked for, of every document,
    from the files: each part's offsets plus its base."""
    kind, out = f"<u{width}", "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    manifest = spark.read.parquet(f"{out_dir}/manifest")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own = filesystem(out_dir)
        for b in it:
            for row in b.to_pylist():
                size, path = row["n_docs"], f"{own}/{row['file']}"
                index = _mapped(fs, f"{path}.off", "<i8")
                for i in range(0, size, READ_DOCS):
                    at = index[i : min(i + READ_DOCS, size) + 1]
                    ids = _mapped(fs, f"{path}.bin", kind, int(at[0]), int(at[-1] - at[0])).astype("<u4")
                    cut = [ids[x - at[0] : y - at[0]].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                    doc = index[size + 1 + i : size + 1 + i + len(cut)]
                    cols = [pa.array(doc, mask=doc == -(2**63)), pa.array(at[:-1] + row["id_base"]), pa.array(np.diff(at)), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(cut, pa.binary())] * with_ids], [c.split()[0] for c in out.split(", ")])

    return manifest.repartition(n).mapInArrow(run, out)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_tokens(spark, out, with_ids=False)
