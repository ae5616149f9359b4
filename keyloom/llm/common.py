"""Shared plumbing: the shared work folder, written tables, Arrow batches of texts and text pieces."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import names
from ..sources.folders import work_folder as shared_dir

#: ASCII white space; words are the maximal runs of anything else (str.split() would also cut at other spaces).
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that one step of the Python side holds at a time.
STEP_CHARS = 4_000_000
#: Bytes of an Arrow batch that Spark hands to Python (or one row).
BATCH_BYTES = 8_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def exists(spark: SparkSession, path: str) -> bool:
    return bool(names(spark, path))


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors. The shuffle files of
    the write go with it, rather than when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def steps(it: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most STEP_CHARS bytes of text (or one row)."""
    for batch in it:
        col = batch.column(batch.schema.get_field_index(text))
        size = pc.binary_length(col).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate([*size, None]):
            if n is None or (total and total + n > STEP_CHARS):
                if i > start:
                    yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0


def batches(it: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """steps() and their texts, null as empty."""
    for part in steps(it, text):
        yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]


_PAIR = re.compile(r"\s \s")
#: ASCII punctuation.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LINES = re.compile(r"\S+(\n\S+)+")
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


def pieces(text: str) -> list[str]:
    """Cuts a text where the byte-level split pattern surely starts anew: before a blank that follows or precedes
    something else than white space. Each piece can be tokenized on its own. A piece stands for a blank and itself (most
    do; no string has to be made for the blank), or, if it starts with a blank, for just what follows that. See whole()."""
    parts = text.split(" ")
    if "" in parts or _PAIR.search(text):
        return [" " + x for x in _CUT.split(text) if x]
    parts[0] = " " + parts[0]
    return parts


def whole(piece: str) -> str:
    """The text that a piece stands for."""
    return piece[1:] if piece[:1] == " " else " " + piece


#: For Arrow: texts that begin or end with a blank, or hold one between white space.
_ODD = r"^$|^ | $|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  "


class Memo:
    """Results (bytes) of texts, put together from those of their pieces, which are kept. The memo starts anew beyond its limit.

    Arrow cuts the texts of a step at blanks and tells the pieces apart, so that each is looked up once; unseen ones are
    handled together, and Arrow gathers the results. Where that cut isn't right for a text, cut() gives its pieces.

    Marks after a Latin-1 letter, and a line end between other things than white space, are matches of their own in all
    patterns here, so `word.` is put together from `word` and `.`, which makes unseen pieces rarer. blanks: pieces are
    those of pieces(), else what is between white space, of which a text is a list."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int = 1_000_000, blanks: bool = True, cut: Callable[[str], list[str]] = pieces, odd: str = _ODD) -> None:
        self.make, self.limit, self.blanks, self.cut, self.odd, self.known = make, limit, blanks, cut, odd, {}

    def __call__(self, texts: pa.Array) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        on = gc.isenabled()
        gc.disable()  # many tuples and lists are made here, and no cycles
        try:
            return self._of(texts.fill_null(""))
        finally:
            if on:
                gc.enable()
            pa.default_memory_pool().release_unused()

    def _of(self, texts: pa.Array) -> list[bytes]:
        if not self.blanks:
            return self._gathered(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), [])
        odd = pc.match_substring_regex(texts, self.odd)
        plain, rest = texts.filter(pc.invert(odd)), [self.cut(t) for t in texts.filter(odd).to_pylist()]
        out = iter(self._gathered(pc.split_pattern(plain, " "), rest))
        first = [next(out) for _ in range(len(plain))]
        own, more = iter(first), out
        return [next(more if x else own) for x in odd.to_pylist()]

    def _values(self, own: list[str]) -> list[bytes]:
        """Results of pieces, in order."""
        known = self.known
        got = list(map(known.get, own))
        if new := [i for i, v in enumerate(got) if v is None]:
            once = self._learn(list(dict.fromkeys([own[i] for i in new])))
            for i in new:
                p = own[i]
                got[i] = once[p] if p in once else known[p]
        return got

    def _gathered(self, lists: pa.Array, rest: list[list[str]]) -> list[bytes]:
        """Results of texts: lists of pieces cut by Arrow (with blanks, the first piece of each stands for itself), then others."""
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(ends[0]) if len(ends) else 0, int(ends[-1] - ends[0]) if len(ends) else 0).dictionary_encode()
        ends -= ends[:1]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = coded.dictionary.to_numpy(zero_copy_only=False)
        first, n = ends[:-1] if self.blanks else ends[:0], len(own)
        starts = [" " + x for x in own[at[first]].tolist()]
        at[first] = n + np.arange(len(first))
        used = np.flatnonzero(np.bincount(at, minlength=n + len(first))[:n])  # some pieces are only first ones
        place = np.zeros(n + len(first), dtype=np.int64)
        place[used] = np.arange(len(used))
        place[n:] = len(used) + np.arange(len(first))
        flat = [p for x in rest for p in x]
        values = pa.array(self._values(own[used].tolist() + starts + flat), pa.large_binary())
        index = np.concatenate([place[at], len(used) + len(first) + np.arange(len(flat))])
        found = values.take(pa.array(index))
        if not len(found):
            return [b""] * (len(lists) + len(rest))
        cut = np.frombuffer(found.buffers()[1], dtype=np.int64)[: len(found) + 1]
        size = np.concatenate([np.diff(ends), np.array([len(x) for x in rest], dtype=np.int64)])
        bounds = cut[np.concatenate([[0], np.cumsum(size)])].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Adds distinct unseen pieces. Those with line ends hardly come again: they are returned, not kept."""
        known, alone = self.known, " " if self.blanks else ""
        lines, todo = [], fresh
        if self.blanks and (lines := [p for p in fresh if "\n" in p and _LINES.fullmatch(p, p[0] == " ")]):
            lines = [(p, [x if i == 0 else " " + x for i, x in enumerate(p.split("\n"))]) for p in lines]
            todo = set(fresh)
            todo.difference_update([p for p, _ in lines])
            todo.update([x for _, own in lines for x in own if x not in known])
            if " \n" not in known:
                todo.add(" \n")
        # a run of marks after a letter; a bar may be a part of a special token
        split, rest = [], []
        for p in todo:
            if p[-1:] in _MARKS and (q := p.rstrip(_MARKS)) and q[-1].isalpha() and q[-1] < "\u0130" and "|" not in p:
                split.append((p, q))
            else:
                rest.append(p)
        if split:
            rest = set(rest)
            rest.update([q for _, q in split if q not in known], [m for m in {alone + p[len(q) :] for p, q in split} if m not in known])
        rest = list(rest)
        known.update(zip(rest, self.make([p[1:] if p[:1] == " " else " " + p for p in rest] if self.blanks else rest), strict=True))
        for p, q in split:
            known[p] = known[q] + known[alone + p[len(q) :]]
        return {p: known[" \n"].join([known[x] for x in own]) for p, own in lines}


def sampled(df: DataFrame, hashed: Column, share: float | Column) -> DataFrame:
    """About that share of the rows, chosen by a 64-bit hash: any share above 0 works, however large the table."""
    top = F.pmod(hashed, F.lit(1 << 62)).cast("double") / float(1 << 62)
    return df.where(top < (F.lit(share) if isinstance(share, float) else share))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator needs, so that others never clash with its own. Batches that go to Python are
    bounded by BATCH_BYTES from here on, not by rows alone: texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(*[df[n] for n in names])
