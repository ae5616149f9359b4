"""Secret scans (operator 3), native: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger has a row for each blob and rule version
that was scanned, with the spans found (none is a finding too). A scan takes one text of each blob with unseen pairs,
scans it with those rules only, appends to the ledger, and joins the spans back to all paths that hold the blob.

Spans come from two regular-expression functions: the gaps between matches (split) and the matches themselves; running
sums of their lengths are the positions, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, exists, shared_dir, written

SPAN = "array<struct<start:int,kind_no:int,stop:int,kind:string>>"
LEDGER = f"blob binary, rule string, spans {SPAN}"
#: Matches whose lengths are summed up in one go.
RUN = 256


def either_case(word: str) -> str:
    """A pattern for a word in either case of its ASCII letters, and of no others."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind and version name the rule; hint is a cheap pattern that any text with a match has; a match counts if its
    group has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
#: The rules. Runs of one class that are long enough can ask for the length in the pattern itself.
RULES = (
    Rule("assign", 1, rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", rf"({_NAMES})[\"']?\x20*[:=]", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(text: Column, rule: Rule) -> Column:
    """Array of (gap, match, found) for a text: every match of the pattern with the gap before it."""
    return F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least).alias("found"),
    )


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule, in order. Texts without the hint are not looked at again.

    Lengths are summed up within runs of RUN matches, and runs are moved by the sums before them, so that many
    findings in one text don't cost their square."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["match"]), F.lit(0))
        own = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind_no"), stop.alias("stop"), F.lit(rule.kind).alias("kind")))
        return F.struct(stop.alias("at"), F.when(x["found"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), s["kind_no"].alias("kind_no"), (s["stop"] + by).alias("stop"), s["kind"].alias("kind"))

    def of_runs(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: F.transform(r["out"], lambda s: moved(s, F.get(e, i))))))

    def of_parts(p: Column) -> Column:
        run = lambda i: F.aggregate(F.slice(p, i * RUN + 1, RUN), zero, step)
        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), run), of_runs)

    return F.when(text.rlike(rule.hint), let(parts(text, rule), of_parts)).otherwise(F.array().cast(SPAN))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


class Ledger:
    """A ledger that stays: a Parquet table below a folder, to which every scan appends what it found.

    A scan that fails appends nothing; one that is repeated finds all its pairs seen."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/ledger"
        if not exists(spark, self.root):
            empty_ledger(spark).write.parquet(self.root)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.root)

    def extend(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> Ledger:
        """Scans what versions hold and the ledger has not seen under these rules."""
        unseen(versions, self.rows(), rules, path_col, text_col).write.mode("append").parquet(self.root)
        return self


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """unseen(), written out once."""
    return written(unseen(versions, ledger, rules, path_col, text_col))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) for the blobs and rule versions of `versions` that `ledger` has not seen.

    Null text counts as the empty blob; a blob under many paths, or twice under one, is scanned once. Of a text of any
    length the spans are found in its row."""
    path, text = F.col(path_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    content = columns(versions, path_col, text_col).select(F.coalesce(path, F.lit("")).alias("path"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    names = F.array(*[F.lit(r.name) for r in rules])
    # Aggregated before any shuffle: a blob that a third of all paths hold is one row for each task.
    todo = content.groupBy("blob").agg(F.min("path").alias("path")).withColumn("rules", names)
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("rules", F.array_except("rules", F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("rules") > 0).drop("seen")
    # Rows that repeat a path and its text lie together after the join: dropping them takes no further exchange.
    picked = content.join(todo.hint("merge"), ["path", "blob"]).dropDuplicates(["path", "blob"])
    found = [F.when(F.array_contains("rules", r.name), F.struct(F.lit(r.name).alias("rule"), spans(F.col("text"), r, i).alias("spans"))) for i, r in enumerate(rules)]
    return picked.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.spans")


def joined_back(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path_col and spans (all rules, by start and then rule) for every row of versions.

    Only blobs with findings are joined; a blob held by many paths is a skewed left row set that Spark can split, as
    nothing above the join needs a blob's rows together."""
    blobs = columns(versions, path_col, text_col).select(path_col, F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("blob"))
    hits = ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0)).distinct()
    # Written first, so that the join has an exchange of its own and Spark can split a blob that many paths hold.
    hits = written(hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    return blobs.join(hits, "blob", "left").select(path_col, F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of the ledger in text replaced by its [kind]; overlapping spans by that of the first.

    All columns and rows stay; null text stays null."""
    hits = ledger.where(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0)).distinct()
    hits = written(hits.groupBy(F.col("blob").alias("_kl_blob")).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_kl_spans")))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

    cut = F.aggregate("_kl_spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = docs.withColumn("_kl_blob", F.unhex(F.sha2(text, 256))).join(hits.hint("merge"), "_kl_blob", "left")
    return out.select(*[F.when(F.col("_kl_spans").isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is extended twice, as when a rule comes later: the second scan sees only the pairs of the new rule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = Ledger(spark, shared_dir(spark)).extend(docs, RULES[:2]).extend(docs)
    found = joined_back(docs, ledger.rows())
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _duck(rule: Rule, number: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (
        f"SELECT doc_id, '{rule.kind}' AS kind, {number} AS kind_no, {rule.least} AS least, string_split_regex(t, '{pattern}') AS gaps, "
        f"regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS own FROM d"
    )


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_duck(r, i) for i, r in enumerate(RULES))}),
u AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE len(whole) > 0),
s AS (SELECT doc_id, kind, kind_no, length(whole[i]) AS n, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u WHERE length(own[i]) >= least),
j AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
      count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, kind_no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
