"""Language ID (operator 5): compression classification with a raw-content zstandard dictionary for each language.

A text is cut into blocks of BLOCK bytes; each block is compressed with each dictionary, and the language with the
smallest total wins. A narrow margin between the best two marks the prediction as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, columns, sampled

#: Bytes of a dictionary; documents of a language that it is gathered from (about); slices, spread over the whole text,
#: that each gives, and their characters at most; languages that are learned at most, the most common first.
DICTIONARY, DOCUMENTS, SLICES, SLICE, LANGUAGES = 64_000, 160, 4, 500, 500
BLOCK, LEVEL = 2048, 6
#: A prediction is rejected if the second best language needs less than this share more.
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that nothing is learned from. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(text: F.Column) -> F.Column:
    """SLICES parts of a text, from its start to its end in equal steps; a short text as it is."""
    at = lambda j: F.floor((F.length(text) - SLICE) * j / (SLICES - 1)).cast("int") + 1
    return F.when(F.length(text) <= SLICES * SLICE, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda j: F.substring(text, at(j), F.lit(SLICE))))


def learn(docs: DataFrame, documents: int = DOCUMENTS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary for each lang of docs (text, lang), the most common first, from about `documents` distinct texts of it chosen by a hash of the text.

    The sample is bounded: documents times SLICES times SLICE characters for each of LANGUAGES languages; each text gives
    equally many bytes, from all over it."""
    docs = columns(docs, "text", "lang").where("lang is not null and text is not null")
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("text")).alias("texts"))
    found = found.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not found:
        return {}
    # copies come into the sample together, so only distinct texts count
    share = F.create_map(*[F.lit(x) for r in sorted(found, key=lambda r: r.lang) for x in (r.lang, min(1.0, documents / r.texts))])
    sample = sampled(docs, F.xxhash64("text"), F.coalesce(share[F.col("lang")], F.lit(0.0)))
    by: dict[str, list[list[str]]] = {}
    for r in sample.select("lang", F.xxhash64("text").alias("h"), slices(F.col("text")).alias("own")).distinct().orderBy("lang", "h").collect():
        by.setdefault(r.lang, []).append(r.own)
    out = {}
    for r in found:
        texts = by.get(r.lang, [])
        each = max(200, size // max(1, len(texts)) - SLICES)
        parts = [x.lower().encode("utf-8", "surrogatepass")[: each // len(own)] for own in texts for x in own]
        out[r.lang] = b"\n".join(parts)
    return {k: v for k, v in out.items() if v}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        import zstandard

        self.langs = list(dictionaries)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def __call__(self, text: str) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = text.lower().encode("utf-8", "surrogatepass")
        cut = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = np.array([sum([len(f(x)) for x in cut]) for f in self.coders], dtype=float)
        best = int(sizes.argmin())
        over = sizes / sizes[best] - 1
        over[best] = np.inf
        margin = float(over.min()) if len(sizes) > 1 else 1.0
        return self.langs[best], float(1 / (1 + np.exp(-over / MARGIN).sum())), margin < MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row. Only text is looked at.

    Null text or no letter in it: `und`, score 0, rejected; so too if no language was learned. Score: the best
    language's share of exp(-excess size / MARGIN). Ties go to the language
    with more documents to learn from. A very long text is compressed block by block."""
    docs = columns(docs, "doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(dictionaries)
        for part, texts in batches(it):
            lang, score, rejected = zip(*[own(t) for t in texts], strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
