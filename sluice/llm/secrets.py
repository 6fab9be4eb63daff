"""Secret scans over an incremental ledger of blobs, in DataFrame functions alone.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is three Parquet tables: which blob every
version of every path held, a folder for each run; which pairs of blob and rule version were scanned; and what was
found. A run scans each blob that is new under the current rules once, whatever number of paths or versions hold it, adds
its rows and joins the findings of its blobs back to its paths; history() does so for all paths of all runs. Findings
are written before the scan marks, and repeated ones count once, so a run that was cut short is safe to repeat.

Texts are shuffled once, one of each blob from each task. Positions come from splitting a text at a rule's matches: the
lengths of the pieces and of the matches, added up, are the spans in code points. Only texts that a rule matches at all
are split.

Defined results: a null text counts as empty; a row with a null path is scanned and reported like any other; repeated
rows each get their blob's findings; equal starts are told in the order of the rules; a text of any length is scanned
whole; columns other than the path's and the text's are left out, whatever their names; an empty table gives an empty
result. Paths are kept as strings and come back in their own type.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import fresh_path, materialize


@dataclass(frozen=True)
class Rule:
    """A pattern, and what of a match must have how many characters at least."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order that breaks ties.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
RULE_VERSION = "base-1"
SCANS, FINDINGS = "blob string, rule_version string", "blob string, rule_version string, kind string, start long, end long"


def _matches(rule: Rule, rank: int) -> F.Column:
    """An array of (kind, rank, i, gap, len, ok) for one rule over column text: gap is what stands between matches."""
    # A rule on one class of characters finds the same long runs, sooner, when the pattern itself asks for the length.
    quick = rule.pattern[:-1] + f"{{{rule.least - (4 if rule.kind == 'access' else 0)},}}" if rule.group == 0 else rule.pattern
    pattern = F.lit(quick)
    found, gaps = F.regexp_extract_all("text", pattern, F.lit(0)), F.split("text", quick, -1)
    value = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
    rows = F.zip_with(
        F.transform(found, lambda m, i: F.struct(i.alias("i"), F.length(m).cast("long").alias("len"), (F.length(value(m)) >= rule.least).alias("ok"))),
        F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))),
        lambda m, g: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), m["i"].alias("i"), F.length(g).cast("long").alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")),
    )
    return F.when(F.col("text").rlike(quick), rows)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (blob, kind, rank, start, end) of all findings in (blob, text), one row for each blob."""
    arrays = [_matches(r, i) for i, r in enumerate(rules)]
    hit = blobs.select("blob", F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull())).alias("m")).filter(F.size("m") > 0)
    rows = hit.select("blob", F.explode("m").alias("m")).select("blob", "m.*")
    along = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(along)
    return rows.withColumn("end", end).filter("ok").select("blob", "kind", "rank", (F.col("end") - F.col("len")).alias("start"), "end")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A ledger table; None if it was never written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else None


def scan(
    versions: DataFrame,
    *,
    path_col: str = "doc_id",
    text_col: str = "text",
    ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """Rows (path, blob, findings), one for each row of versions; findings: sorted array of (start, rank, end, kind).

    ledger: folder that keeps the ledger from run to run; None starts a new one in the shared folder.
    """
    spark, ledger = versions.sparkSession, ledger or fresh_path(versions.sparkSession, "ledger")
    kind = versions.schema[path_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = versions.select(F.col(path_col).cast("string").alias("path"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
    own = f"{ledger}/versions/run={uuid.uuid4().hex}"
    full.select("path", "blob").write.parquet(own)
    paths = spark.read.schema("path string, blob string").parquet(own)
    # One text for each blob: equal texts are reduced in the tasks that read them, before the only shuffle of texts.
    blobs = full.groupBy("blob").agg(F.first("text").alias("text"))
    fresh, seen = paths.select("blob").distinct(), _read(spark, f"{ledger}/scans", SCANS)
    if seen is not None:
        seen = seen.filter(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs, fresh = blobs.join(seen, "blob", "left_anti"), materialize(fresh.join(seen, "blob", "left_anti"), "fresh")
    found = find(blobs.select("blob", "text"), rules)
    found.select("blob", F.lit(rule_version).alias("rule_version"), "kind", "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    fresh.select("blob", F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{ledger}/scans")
    lists = _lists(spark, ledger, rules, rule_version, paths.select("blob").distinct())
    return _told(paths, lists).withColumn("path", F.col("path").cast(kind))


def _lists(spark, ledger: str, rules: tuple[Rule, ...], rule_version: str, blobs: DataFrame | None) -> DataFrame:
    """Rows (blob, findings) of the ledger, of all blobs or those asked for. A set, as a run that was repeated wrote twice."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    rows = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings").filter(F.col("rule_version") == rule_version)
    if blobs is not None:
        rows = rows.join(blobs, "blob", "left_semi")
    return rows.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("findings"))


def _told(paths: DataFrame, lists: DataFrame) -> DataFrame:
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    return paths.join(lists, "blob", "left").select("path", "blob", F.coalesce("findings", empty).alias("findings"))


def history(spark: SparkSession, ledger: str, *, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Rows (path, blob, findings) of every version that any run put into the ledger, paths as strings, each pair once."""
    versions = spark.read.schema("path string, blob string").parquet(f"{ledger}/versions").select("path", "blob").distinct()
    return _told(versions, _lists(spark, ledger, rules, rule_version, None))


def spans(findings: F.Column) -> F.Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: F.Column, findings: F.Column, mark: str = "[SECRET]") -> F.Column:
    """The text with every finding replaced by the mark; overlapping ones are replaced together."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        kept = F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        # A finding that begins inside the one before it lengthens that one's gap only.
        return F.struct(F.when(fresh, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))))
