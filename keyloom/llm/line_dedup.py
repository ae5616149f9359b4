"""Line dedup (operator 9), native: content-defined chunks of lines, removed where they repeat in the corpus.

A rolling hash runs over the hashes of the last two lines; a chunk ends where it is less than at the lines beside. So
boundaries follow the content, inserted or deleted lines only move the chunks beside them, and chunks have two lines or
more, three on average. At the ends of a repeated passage chunks also hold lines that differ. So that nothing long is lost there,
each line with words also begins and ends a chunk of just as many lines as have SPAN words. The whole of every run of
lines that holds SPAN words or more, and comes again, is thus covered by chunks, however its words are dealt to lines.

Chunks (two lines with words, or SPAN words) count by digest over all documents. The first one, by doc_id and then place,
stays; the lines of the others go after their bytes were compared with lines of first ones. Chunks that overlap the first one
in its own text stay too. A line that goes has an equal one at an earlier place, so of equal lines one always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, columns, written
from .secrets import let

SPAN = 50
_SHIFT = 1 << 32


def chunks(text: Column) -> Column:
    """Array of struct(first, last, key): ranges of lines (from 0) and the digests of what they hold. Linear in the text."""

    def of_lines(lines: Column) -> Column:
        return let(F.transform(lines, lambda x: F.struct(F.md5(x).alias("hash"), F.regexp_count(x, F.lit(WORD)).alias("words"))), of_marks)

    def of_marks(m: Column) -> Column:
        # the line of each word
        at = F.flatten(F.transform(m, lambda x, i: F.array_repeat(i, x["words"])))
        ranges = F.array_distinct(F.concat(defined(m), let(at, spans)))
        key = lambda first, last: F.unhex(F.md5(F.array_join(F.transform(F.slice(m, first + 1, last - first + 1), lambda x: x["hash"]), "")))
        both = F.transform(ranges, lambda r: F.struct(F.shiftright(r, 32).cast("int").alias("first"), (r % _SHIFT).cast("int").alias("last")))
        return F.transform(both, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), key(r["first"], r["last"]).alias("key")))

    def defined(m: Column) -> Column:
        """Codes of content-defined chunks with two lines with words."""
        last = F.size(m) - 1
        rolling = F.transform(m, lambda x, i: F.md5(F.concat(F.coalesce(F.get(m, i - 1)["hash"], F.lit("")), x["hash"])))

        def of_rolling(r: Column) -> Column:
            dips = lambda i: (i > 0) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))
            return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | dips(i))

        def of_ends(e: Column) -> Column:
            own = F.transform(e, lambda stop, j: F.struct(F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1).alias("first"), stop.alias("last")))
            counts = lambda c: F.size(F.filter(F.slice(m, c["first"] + 1, c["last"] - c["first"] + 1), lambda x: x["words"] > 0)) >= 2
            return F.transform(F.filter(own, counts), lambda c: code(c["first"], c["last"]))

        return let(let(rolling, of_rolling), of_ends)

    def spans(at: Column) -> Column:
        """Codes of the lines that SPAN words take from the first word of each line on, or up to its last one."""
        n = F.size(at)
        starts = F.filter(F.sequence(F.lit(0), n - SPAN), lambda p: (p == 0) | (F.get(at, p) != F.get(at, p - 1)))
        ends = F.filter(F.sequence(F.lit(SPAN - 1), n - 1), lambda p: (p == n - 1) | (F.get(at, p) != F.get(at, p + 1)))
        found = F.concat(F.transform(starts, lambda p: code(F.get(at, p), F.get(at, p + SPAN - 1))), F.transform(ends, lambda p: code(F.get(at, p - SPAN + 1), F.get(at, p))))
        return F.when(n >= SPAN, found).otherwise(F.array().cast("array<bigint>"))

    def code(first: Column, last: Column) -> Column:
        return first.cast("long") * _SHIFT + last

    return let(F.split(text, "\n", -1), of_lines)


def _numbers(ranges: Column) -> Column:
    """The distinct line numbers of ranges."""
    return F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"]))))


def repeated(docs: DataFrame) -> DataFrame:
    """doc, row, gone (array of line numbers): lines to remove, by document; doc and row name a row of docs."""
    own = _named(columns(docs, "doc_id", "text")).select("doc", "row", "text")
    found = written(own.where("text is not null").select("doc", "row", F.inline(chunks(F.col("text")))))
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "row", "first", "last")).alias("one")).where("n > 1").drop("n")
    # A chunk that a third of all documents hold makes one left row set that Spark can split: the join is plain.
    marks = found.join(twice, "key").withColumn("here", (F.col("one.doc") == F.col("doc")) & (F.col("one.row") == F.col("row")))
    keeps = F.col("here") & (F.col("one.first") == F.col("first")) & (F.col("one.last") == F.col("last"))
    goes = ~(F.col("here") & (F.col("first") <= F.col("one.last")))
    marks = marks.select("doc", "row", "first", "last", goes.alias("goes"), keeps.alias("keeps")).where("goes or keeps").drop("keeps")
    by_doc = marks.groupBy("doc", "row").agg(F.collect_set(F.struct("first", "last", "goes")).alias("marks"))
    # Never a broadcast: marks grow with the corpus. Each text is split once, each line told once for either role.
    split = own.join(by_doc.hint("merge"), ["doc", "row"]).select("doc", "row", "marks", F.split("text", "\n", -1).alias("lines"))
    of = lambda goes: F.transform(_numbers(F.filter("marks", lambda r: r["goes"] == goes)), lambda i: F.struct(i.alias("i"), F.lit(goes).alias("goes"), F.get("lines", i).alias("line")))
    lines = written(split.select("doc", "row", F.inline(F.concat(of(True), of(False)))).withColumn("hash", F.unhex(F.md5("line"))))
    kept = lines.where("not goes").groupBy("hash").agg(F.min("line").alias("kept"))
    same = lines.where("goes").join(kept.hint("merge"), "hash").where(F.col("line") == F.col("kept"))  # the byte comparison
    return same.groupBy("doc", "row").agg(F.collect_set("i").alias("gone"))


def _named(docs: DataFrame) -> DataFrame:
    """Adds doc and row: doc_id with null as the least value, and a hash that tells rows of one doc_id apart by text."""
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(-(2**63))), "row": F.xxhash64("text")})


def dedup(docs: DataFrame, extra: bool = False) -> DataFrame:
    """docs with the lines of repeated chunks cut out of text; with extra also n_lines and n_removed (lines). All rows stay.

    Null text stays null (0 lines), no rows give none. Rows equal in doc_id and text count as one document; of rows with one
    doc_id and different texts, the one with the lesser hash is first. Other columns are untouched, whatever their names.
    A very long text is handled in one row, in time linear in its length."""
    gone = written(repeated(docs).select(F.col("doc").alias("_kl_doc"), F.col("row").alias("_kl_row"), F.col("gone").alias("_kl_gone")))

    def body(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_kl_gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    own = docs.withColumns({"_kl_doc": F.coalesce("doc_id", F.lit(-(2**63))), "_kl_row": F.xxhash64("text")})
    out = own.join(gone.hint("merge"), ["_kl_doc", "_kl_row"], "left")
    removed = F.coalesce(F.size("_kl_gone"), F.lit(0)).cast("long")
    text = F.when(F.col("_kl_gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), body))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([lines.alias("n_lines"), F.greatest(removed, F.lit(0)).alias("n_removed")] if extra else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, extra=True)


OP9_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
h AS (SELECT *, md5(line) AS hash, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
b AS (SELECT *, lead(i) OVER w IS NULL AS final, md5(coalesce(lag(hash) OVER w, '') || hash) AS rolling,
      sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, upto - words AS before, final OR coalesce(i > 0 AND rolling < lag(rolling) OVER w AND rolling < lead(rolling) OVER w, false) AS ends
      FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM e),
r AS (SELECT doc_id, min(i) AS first, max(i) AS last FROM c GROUP BY doc_id, j HAVING count(*) FILTER (WHERE words > 0) >= 2
      UNION SELECT x.doc_id, x.i, y.i FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.words > 0 AND y.upto >= x.before + {SPAN} AND y.before < x.before + {SPAN}
      UNION SELECT x.doc_id, y.i, x.i FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.words > 0 AND y.before <= x.upto - {SPAN} AND y.upto > x.upto - {SPAN}),
g AS (SELECT r.doc_id, r.first, r.last, string_agg(line, chr(10) ORDER BY i) AS body FROM r JOIN l ON r.doc_id = l.doc_id AND i BETWEEN r.first AND r.last GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS one, first_value(last) OVER w AS one_last FROM g WINDOW w AS (PARTITION BY body ORDER BY doc_id, first, last)),
x AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM k WHERE nth > 1 AND NOT (doc_id = one AND first <= one_last)),
o AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL), '') AS text, count(*) AS n_lines, count(x.i) AS n_removed
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE o.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
