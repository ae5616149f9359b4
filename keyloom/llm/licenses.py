"""License scans (operator 8): sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every text is searched for licence lines (a trigger word, or the SPDX tag). From each such line, and from the line before,
passages of 1, 2, 4 ... PASSAGE lines are taken, of a licence file also passages from its start and the whole; each becomes a sparse
vector over the words of the templates, weighted by inverse document frequency over all texts. The best template at or
above the threshold is the file's own licence. A licence file also
speaks for its directory: a file without a licence of its own takes that of the nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, written
from .license_texts import TEMPLATES

#: Lines of the longest passage that is compared (a licence file is also compared whole).
PASSAGE = 64
TRIGGER = re.compile(
    r"licen[cs]e|rights reserved|public domain|creative commons|permission (is|to use)\b|redistribution and use|is free software|source code form|provided 'as-is'|\bmit no attribution\b|\bcc0\b|\bcc by\b", re.I
)
SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")
LICENSE_FILE = r"(^|/)(LICEN[CS]E|COPYING|NOTICE)(\.[a-z]+)?$"
THRESHOLD = 0.7
_WORD = re.compile(r"[a-z0-9]+")

VOCABULARY = frozenset(w for texts in TEMPLATES.values() for t in texts for w in _WORD.findall(t.lower()))


def frequencies(files: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each word of the templates; at most one row a word comes to the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for _, texts in batches(it, text_col):
            for t in texts:
                found.update(VOCABULARY.intersection(_WORD.findall(t.lower())))
                found[""] += 1  # the texts themselves
        if found:
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    rows = {r.word: r.n for r in columns(files, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return rows.pop("", 0), rows


class Matcher:
    def __init__(self, texts: int, frequency: dict[str, int]) -> None:
        self.idf = {w: math.log((1 + texts) / (1 + frequency.get(w, 0))) + 1 for w in VOCABULARY}
        self.unseen = math.log(1 + texts) + 1
        self.names = [name for name, own in TEMPLATES.items() for _ in own]
        self.holders: dict[str, list[tuple[int, float]]] = {}
        for i, t in enumerate(t for own in TEMPLATES.values() for t in own):
            for w, x in self.vector(t).items():
                self.holders.setdefault(w, []).append((i, x))
        self.known: dict[str, tuple[str | None, float]] = {}

    def vector(self, text: str) -> dict[str, float]:
        """A unit vector. Words outside the templates count for its length only, each once and at most as a rare word."""
        count = Counter(_WORD.findall(text.lower()))
        v = {w: n * self.idf[w] for w, n in count.items() if w in VOCABULARY}
        others = sum(w not in VOCABULARY for w in count)
        length = math.sqrt(sum(x * x for x in v.values()) + others * self.unseen**2)
        return {w: x / length for w, x in v.items()} if length else {}

    def best(self, text: str) -> tuple[str | None, float]:
        if text not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            v, scores = self.vector(text), {}
            for w, x in v.items():  # by the templates that have the word
                for i, y in self.holders.get(w, ()):
                    scores[i] = scores.get(i, 0.0) + x * y
            score, name = max(((s, self.names[i]) for i, s in scores.items()), default=(0.0, ""))
            self.known[text] = (name, score) if score >= THRESHOLD else (None, score)
        return self.known[text]

    def license(self, text: str, whole: bool) -> tuple[str | None, float]:
        """The best licence named in a text; whole: the text as such counts too (a licence file). An SPDX tag is a name
        and needs no likeness. Of equal scores the greatest name counts."""
        if m := SPDX.search(text):
            return m[1], 1.0
        lines, found = text.split("\n") if whole or TRIGGER.search(text) else [], []
        starts = {0} if whole else set()
        for i, line in enumerate(lines):
            if TRIGGER.search(line):
                starts.update((max(0, i - 1), i))
        for i in starts:
            size = 1
            while True:
                found.append(self.best(" ".join(lines[i : i + size])))
                if size >= PASSAGE or i + size >= len(lines):
                    break
                size *= 2
        if whole:
            found.append(self.best(text))
        found = [x for x in found if x[0]]
        return max(found, key=lambda x: (x[1], x[0])) if found else (None, 0.0)


def own_licenses(files: DataFrame, id_col: str | None = None) -> DataFrame:
    """path, license, score (cosine), is_license_file, and id_col if given, of every row of files (path, text).

    Null text: none. An SPDX tag goes before all else. A very long text is split into lines once; each passage is
    bounded, but for the whole of a licence file."""
    names = ["path", "text", *[id_col] * bool(id_col)]
    files = columns(files, *names)
    counted = frequencies(files)
    is_file = re.compile(LICENSE_FILE)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(*counted)
        for part, texts in batches(it):
            paths = part.column(0).to_pylist()
            whole = [bool(is_file.search(p or "")) for p in paths]
            found = [own.license(t, w) for t, w in zip(texts, whole, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([round(s, 6) for _, s in found], pa.float64()), pa.array(whole), *part.columns[2:]],
                ["path", "license", "score", "is_license_file", *names[2:]],
            )

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in files.schema[2:])
    return files.mapInArrow(run, "path string, license string, score double, is_license_file boolean" + kinds)


def scan(files: DataFrame, id_col: str | None = None) -> DataFrame:
    """path, own_license, score, license, inherited_from, and id_col if given, of every row of files (path, text).

    inherited_from: the directory whose licence file gave the licence, null if the licence is the file's own or there is
    none. If a directory has several licence files, the least path decides, then the least licence. Null path: no
    directory. Repeated rows stay. No rows give none."""
    own = written(own_licenses(files, id_col))
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    given = own.where("is_license_file and license is not null").groupBy(directory.alias("directory")).agg(F.min(F.struct("path", "license"))["license"].alias("given"))
    # Only directories of files without a licence look further up, each once.
    asks = own.where("license is null and path is not null").select(directory.alias("asks")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("asks", "/"))), lambda n: F.struct(n.alias("n"), F.call_function("substring_index", F.col("asks"), F.lit("/"), n).alias("directory")))
    tried = asks.select("asks", F.explode(above).alias("x")).select("asks", "x.n", "x.directory")
    nearest = tried.join(given, "directory").groupBy("asks").agg(F.max(F.struct("n", "directory", "given")).alias("best"))
    nearest = written(nearest.select("asks", F.col("best.directory").alias("inherited_from"), F.col("best.given").alias("given")))
    out = own.withColumn("asks", F.when(F.col("license").isNull(), directory)).join(nearest, "asks", "left")
    return out.select(*[id_col] * bool(id_col), "path", F.col("license").alias("own_license"), "score", F.coalesce("license", "given").alias("license"), "inherited_from")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths, so they get some from source and id; every 50th is the licence file of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = lambda n: F.expr(f"cast(doc_id div {n} as string)")
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), number(1000))
    path = F.when(F.col("doc_id") % 500 == 0, F.concat_ws("/", top, name)).otherwise(F.concat_ws("/", top, number(50), name))
    return scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id")
