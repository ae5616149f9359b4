"""Quality rules (operator 2): rule statistics, and isolation forests over them.

A tree splits a small random subsample by random features at random places until rows stand alone; anomalous rows do so
after few splits. The score of a row is 2 ** -(mean path / expected path), 0 to 1. Features with heavier tails are drawn
more often (by their kurtosis), as anomalies show there. There is a forest for what characters are like and one for how long
and how repetitive a text is, since a row that is odd in the one would hide in splits by the other. Each forest's
threshold comes from all labelled rows: the score that all but SPARE of the rows labelled good stay under, by its exact
rank; above any, a row goes. The few rows that each tree splits are drawn from all labelled rows. All rows are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, written

TREES, ROWS, SEED = 200, 256, 7
#: Values that the driver sorts to find a rank; bins of a step that narrows more of them down.
EXACT, BINS = 10_000, 1000
#: Share of the rows labelled good that may lie above a forest's threshold.
SPARE = 0.0015
#: Share of rows not labelled good among those that trees are grown from, if enough good ones are there: anomalies have
#: to be few, or splits between them keep them from standing alone early.
RARE = 0.03
#: Words of ordinary text (of five letters, one capital in fifty characters) that are added to each text before its
#: shares are taken, so that short texts don't stand out by chance; and its lines.
PRIOR, PRIOR_LINES = 60, 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Columns of statistics() that each forest splits.
GROUPS = (slice(5, 9), slice(9, 12))
#: The characters that count as symbols, white space of words, and the limits of the base rules.
SYMBOLS, SPACE, CAPITALS, MARKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?"
MIN_WORDS, REPEAT_PERCENT = 10, 20


def statistics(text: str) -> tuple[float, ...]:
    """The five counts of STATS, then features: mean word, shares of symbols, capitals and marks; the words (in powers of
    two), shares of doubled lines and of repeated words. Of a text of any length a few arrays of its words are held."""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]  # bytes.split() cuts at ASCII white space only
    n, size = len(words), len(raw)
    chars = len(text) - (size - len(raw.translate(None, SPACE)))
    symbols = size - len(raw.translate(None, SYMBOLS))
    doubled = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    capitals, marks = (size - len(raw.translate(None, x)) for x in (CAPITALS, MARKS))
    return (
        n, chars, symbols, doubled, repeated,
        (chars + 5 * PRIOR) / (n + PRIOR), symbols / (n + PRIOR), (capitals + 0.1 * PRIOR) / (size + 6 * PRIOR), marks / (n + PRIOR),
        math.log2(1 + n), doubled / (len(lines) + PRIOR_LINES), repeated / (n + PRIOR),
    )


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window found twice or more."""
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(own) or len(own) <= width:
        return 0
    window = own
    for i in range(1, width):  # equal windows have equal numbers, at each width
        window = np.unique(window[:-1] * len(own) + own[i:], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    covered = np.zeros(len(own), dtype=bool)
    for i in range(width):
        covered[i : i + len(window)] |= twice
    return int(covered.sum())


def _depth(n: np.ndarray | float) -> np.ndarray:
    """Expected path of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2)
    return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0)


def _tails(x: np.ndarray) -> np.ndarray:
    """Odds of columns, by their kurtosis. Each column has more than one value."""
    x = (x - x.mean(axis=0)) / np.ptp(x, axis=0)
    heavy = (x**4).mean(axis=0) / np.maximum((x**2).mean(axis=0) ** 2, 1e-12)
    return heavy / heavy.sum()


@dataclass
class Forest:
    """Trees as heaps of one size: feature (-1: leaf), place of the split, path length at a leaf."""

    feature: np.ndarray
    place: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float = 1.0

    @staticmethod
    def fit(x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        levels = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        nodes = 2 ** (levels + 1) - 1
        feature, place, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), rows, replace=False)])]
            while todo:
                node, level, own = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                usable = np.flatnonzero(high > low)
                if level == levels or not len(usable):
                    path[t, node] = level + _depth(len(own))
                    continue
                f = feature[t, node] = rng.choice(usable, p=_tails(own[:, usable]))
                at = place[t, node] = rng.uniform(low[f], high[f])
                left = own[:, f] < at
                if left.all() or not left.any():  # the split fell on the edge of floating point
                    feature[t, node], path[t, node] = -1, level + _depth(len(own))
                    continue
                todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
        return Forest(feature, place, path, float(_depth(rows)) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, place, path in zip(self.feature, self.place, self.path, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                right = x[rows, feature[node]] >= place[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / self.scale)


def verdict(x: np.ndarray, forests: list[Forest]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the base rules fail, the greatest score, and whether the row is kept, of rows of statistics()."""
    failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > REPEAT_PERCENT * x[:, 0])
    scores = [f.score(x[:, g]) for f, g in zip(forests, GROUPS, strict=False)]
    kept = ~failed
    for f, s in zip(forests, scores, strict=True):
        kept &= s <= f.threshold
    return failed, np.max(scores, axis=0) if scores else np.zeros(len(x)), kept


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and features (statistics() as an array) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(it):
            x = [statistics(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "features"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, features array<double>")


def _matrix(features: pa.Array) -> np.ndarray:
    return np.array(features.to_pylist(), dtype=float).reshape(len(features), -1)


def ranked(values: DataFrame, name: str, k: int) -> float:
    """The value of a column that has place k (from 0) in ascending order, however many there are: bins between the least and
    the greatest value are counted, and only that of the place is looked at again."""
    own = values.select(F.col(name).alias("v"))
    low, high, n = own.agg(F.min("v"), F.max("v"), F.count("v")).first()
    while n > EXACT and low < high:
        at = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for b in own.groupBy(at.alias("at")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("at").collect():
            low, high, n = b.low, b.high, b.n
            if k < n:
                break
            k -= n
        own = own.where(F.col("v").between(low, high))
    return low if low == high else sorted(r.v for r in own.collect())[k]


def fit(docs: DataFrame, labels: DataFrame, spare: float = SPARE) -> list[Forest]:
    """A forest for each of GROUPS, from all labelled rows. None without such rows.

    labels: doc_id, quality (0 or 1); rows without either are left out."""
    return _fit(measure(docs), labels, spare)


def _fit(measured: DataFrame, labels: DataFrame, spare: float = SPARE) -> list[Forest]:
    labels = columns(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    f = lambda i: F.col("features")[STATS.index(i)]
    passed = measured.where((f("n_words") >= MIN_WORDS) & (100 * f("n_repeat_words") <= REPEAT_PERCENT * f("n_words")))
    rows = written(passed.groupBy("doc_id").agg(F.min("features").alias("features")).join(labels, "doc_id").select("doc_id", "features", (F.col("quality") == 1).alias("good")))
    # A tree draws ROWS rows; all trees together can't draw more than this many.
    drawn = lambda good, n: [r.features for r in rows.where(good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    x = drawn("good", TREES * ROWS)
    bad = drawn("not good", TREES * ROWS if len(x) < 30 else max(1, int(RARE / (1 - RARE) * len(x))))
    if not x and not bad:
        return []
    grown = np.array(sorted(x + bad))
    out = [Forest.fit(grown[:, g]) for g in GROUPS]
    if x:

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                own = _matrix(b["features"])
                yield pa.RecordBatch.from_arrays([pa.array(f.score(own[:, g])) for f, g in zip(out, GROUPS, strict=True)], ["s0", "s1"])

        scores = written(rows.where("good").select("features").mapInArrow(run, "s0 double, s1 double"))
        place = math.ceil((scores.count() - 1) * (1 - spare))
        for i, forest in enumerate(out):
            forest.threshold = ranked(scores, f"s{i}", place)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, score, kept of every row of docs.

    Null text: no words, so base_failed. Without labelled rows only the base rules reject. Null and repeated doc_ids
    stay, further columns are ignored, no rows give none. Texts are read once: their statistics are written."""
    measured = written(measure(docs))
    forests = _fit(measured, labels)
    out = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, score double, kept boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            if part.num_rows:
                x = _matrix(part["features"])
                failed, score, kept = verdict(x, forests)
                cols = [part["doc_id"], *(pa.array(c) for c in x[:, :5].astype(np.int64).T), pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in out.split(", ")])

    return measured.mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, that the rules and the forest keep. Texts are read twice, for the forests and
    for the verdicts, and never shuffled."""
    forests = fit(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(it, names[at]):
            x = np.array([statistics(t) for t in texts], dtype=float)
            yield part.filter(pa.array(verdict(x, forests)[2]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
