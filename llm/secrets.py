"""Secret scans with a ledger of blobs: every content is scanned once per rule version.

Each version of a path is content-addressed by SHA-256. Pairs of blob and rule version that the ledger holds are passed
over; the others are scanned, and findings are joined back to all paths that have the blob. Everything is a column
expression: the texts between matches and the matches themselves give the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.session import ready, stored


@dataclass(frozen=True)
class Rule:
    """A pattern with a version; a match counts if ``group`` of it has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, then kinds that the scan adds. Runs that a kind drops for their length are left out by the
#: pattern where that changes no other match.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("bearer", 1, r"[Bb]earer\x20+[A-Za-z0-9+/_.=-]{16,}", 0, 0),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob binary, rule string"
FINDINGS = "blob binary, rule string, kind string, start int, end int"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _matches(text: Column, rule: Rule, wanted: Column) -> Column:
    """For each match: characters since the last one, characters of the match, and whether it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else sizes
    found = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size"))), tested,
                       lambda x, t: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), (t >= rule.least).alias("counts")))
    return F.when(wanted & text.rlike(rule.pattern), found)


def scan(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, kind, start, end): findings of the blobs and rule versions that the ledger lacks; ends are exclusive, in code points.

    ``ledger`` has (blob, rule) of earlier scans; append ``scanned()`` to it after the findings are written. A null text
    is the empty blob. Equal texts are one blob whatever their number. An empty table gives no findings.
    """
    contents = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(blob_of(F.col("text")).alias("blob"), "text") \
        .groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        contents = contents.join(seen, "blob", "left")
    else:
        contents = contents.withColumn("seen", F.array().cast("array<string>"))
    new = [F.coalesce(~F.array_contains("seen", r.name), F.lit(True)) for r in rules]
    hits = F.flatten(F.filter(F.array(*[_matches(F.col("text"), r, n) for r, n in zip(rules, new)]), lambda x: x.isNotNull()))
    rows = contents.select("blob", F.posexplode(hits).alias("at", "hit")).select("blob", "at", "hit.*")
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    return rows.withColumn("end", end).where("counts").select("blob", "rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def scanned(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule): the pairs that ``scan`` with the same arguments looks at."""
    pairs = versions.select(blob_of(F.col(text)).alias("blob")).distinct() \
        .withColumn("rule", F.explode(F.array(*[F.lit(r.name) for r in rules])))
    return pairs if ledger is None else pairs.join(ledger, ["blob", "rule"], "left_anti")


def findings_of_paths(versions: DataFrame, findings: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``found``: all findings of its blob as (start, order, kind, end), sorted; an empty array if there are none.

    Findings are gathered per blob before the join, so a blob that many paths share is gathered once. All
    columns of ``versions`` but the text come back (one named ``found`` is replaced); repeated rows stay.
    """
    order = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    one = F.struct("start", order.alias("order"), "kind", "end")
    per_blob = findings.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.collect_list(one)).alias("__found"))
    paths = versions.withColumn("__blob", blob_of(F.col(text))).drop(text)
    nothing = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    return paths.join(per_blob, "__blob", "left").withColumn("found", F.coalesce("__found", nothing)).drop("__blob", "__found")


def joined_spans(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """(key, found) of every row after one scan of the blobs and rule versions that ``ledger`` lacks.

    A null or empty text is the empty blob, without findings. Null keys and repeated rows stay; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    return findings_of_paths(docs.select(key, text), scan(docs, text, ledger), text)


#: The rules as they were put to use: the base kinds first, then all. A later step scans what the ledger lacks, here the added kinds.
STEPS = (tuple(r for r in RULES if r.kind in BASE), RULES)


def ledgered_report(docs: DataFrame, key: str = "doc_id", text: str = "text", steps: tuple[tuple[Rule, ...], ...] = STEPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, found) of every row, findings, ledger) after incremental scans, one per step of ``steps``.

    Findings and scanned pairs of each step are written to the shared folder; the next one reads the ledger and scans unseen pairs of blob and
    rule version only. Findings of all steps are joined back to all rows. Nulls, empty texts and repeated rows are as in ``secret_report``.
    """
    ready(docs.sparkSession)
    findings = ledger = None
    for rules in steps:
        found, pairs = stored(scan(docs, text, ledger, rules)), stored(scanned(docs, text, ledger, rules))
        findings = found if findings is None else findings.unionByName(found)
        ledger = pairs if ledger is None else ledger.unionByName(pairs)
    return findings_of_paths(docs.select(key, text), findings, text), findings, ledger
