"""One table of findings: what a finding is, dedup, and a run over files of all modules that apply.

A finding is repo_id, id, title, severity, module, check, category, confidence,
evidence (type, source, location, excerpt), cves, fingerprint.  Excerpts are
masked here and nowhere else, and the fingerprint is of what is seen, not of line
numbers, so that a finding stays the same when lines move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import text as t
from auditlake.operators import modules, scan
from auditlake.operators import rules as r
from auditlake.operators.module_rules import CHECKS, MODULES, RECORDS
from auditlake.sources.shared import durable

COLUMNS = ["repo_id", "id", "title", "severity", "module", "check", "category", "confidence", "type", "source", "location", "excerpt", "cves", "fingerprint"]


def make_findings(found: DataFrame) -> DataFrame:
    """Findings of rows that have COLUMNS but cves and fingerprint (cves may be there): excerpts masked, fingerprint added.

    A finding with several pieces of evidence has them in ``more``, an array of
    (source, excerpt, location); they are part of the fingerprint.
    """
    sign = lambda source, excerpt, place: F.concat_ws("|", source, t.normalize_ws(F.coalesce(excerpt, place, F.lit(""))))
    out = found.withColumn("excerpt", t.mask_secrets(F.col("excerpt")))
    signatures = F.array(sign(F.col("source"), F.col("excerpt"), F.col("location")))
    if "more" in found.columns:
        signatures = F.concat(signatures, F.transform("more", lambda e: sign(e["source"], t.mask_secrets(e["excerpt"]), e["location"])))
    if "cves" not in found.columns:
        out = out.withColumn("cves", F.lit(None).cast("array<string>"))
    return out.withColumn("fingerprint", t.fingerprint(F.col("module"), F.col("check"), F.col("title"), signatures)).select(*COLUMNS)


def deduped(findings: DataFrame) -> DataFrame:
    """The first finding of each repository, module and fingerprint: by source, then line, then id; partial minima, so that no group gathers."""
    key = ["repo_id", "module", "fingerprint"]
    rest = [c for c in COLUMNS if c not in key]
    place = F.struct("source", F.expr("try_cast(location AS long)").alias("line"), "id")
    best = findings.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("f"))
    return best.select(*key, "f.*").select(*COLUMNS)


def union_modules(parts: list[DataFrame]) -> DataFrame:
    """One table of all modules' findings, each module deduplicated for itself."""
    return deduped(reduce(lambda a, b: a.unionByName(b), (p.select(*COLUMNS) for p in parts)))


def rule_findings(files: DataFrame, rules: list[r.Rule], kind: str = "file", width: int = 200) -> DataFrame:
    """Findings of line rules, capped by rule and file before dedup."""
    hits = scan.capped(scan.described(scan.file_matches(files, rules), rules), F.col("cap"))
    line = F.col("line_no").cast("string")
    return make_findings(
        hits.select(
            "repo_id", F.concat_ws(":", "rule_id", "path", line).alias("id"), "title", "severity", "module", "check", "category", "confidence", F.lit(kind).alias("type"), F.col("path").alias("source"), line.alias("location"),
            F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, width).alias("excerpt"),
        )
    )


def _records(checks: DataFrame) -> DataFrame:
    """checks with head, title, category, words, confidence of their check."""
    spark = checks.sparkSession
    sure = {(c.id, c.severity): c.confidence for c in CHECKS} | {(f"FLOW-{i}", s): "low" for i, s in ((1, "P1"), (2, "P1"), (3, "P2"))}
    table = spark.createDataFrame([(c, s, *RECORDS[c], sure[c, s]) for c, s in sure], "check string, severity string, head string, title string, category string, words string, confidence string")
    return checks.join(F.broadcast(table), ["check", "severity"])  # a row a check


def module_findings(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Findings of the application modules (those named in ``only``, or all) that apply to a repository."""
    seen = modules.looked_at(files)
    flags = modules.flags_of(seen)
    named = only or list(MODULES)
    heads = {m: [c.id for c in CHECKS if c.module == m] for m in named}
    wanted = F.col("check").isin([c for cs in heads.values() for c in cs])
    hits = _records(modules.hits_of(seen, flags).where(wanted))
    hits = hits.withColumn("title", F.coalesce("own_title", "title")).where("title != ''")
    line = F.col("line_no").cast("string")
    of_line = F.col("words") == ""
    excerpt = F.when(of_line, F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, 160)).otherwise(F.col("words"))
    module = lambda c: F.when(c.startswith("ACC-"), "ACCESS").otherwise(F.split_part(c, F.lit("-"), F.lit(1)))
    there = hits.select("repo_id", F.concat_ws(":", "head", "path", F.when(of_line, line)).alias("id"), "title", "severity", module(F.col("check")).alias("module"), "check", "category", "confidence", F.lit("file").alias("type"), F.col("path").alias("source"), line.alias("location"), excerpt.alias("excerpt"))
    lacks = _records(modules.repo_checks(flags, anchors=True).where(wanted))
    lacks = lacks.select("repo_id", F.col("head").alias("id"), "title", "severity", module(F.col("check")).alias("module"), "check", "category", "confidence", F.lit("config").alias("type"), F.col("anchor").alias("source"), F.lit(None).cast("string").alias("location"), F.col("words").alias("excerpt"))
    return make_findings(there.unionByName(lacks))


def flow_findings(files: DataFrame) -> DataFrame:
    """Findings of handlers: their words tell how many writes there are, and to what."""
    hits = _records(modules.flow_checks(modules.handler_stats(modules.handler_segments(files)), keep=("mutations", "targets", "change_line")))
    words = F.replace(F.replace("words", F.lit("{mutations}"), F.col("mutations").cast("string")), F.lit("{targets}"), F.col("targets"))
    line = F.when(F.col("check") == "FLOW-2", F.col("change_line")).otherwise(F.col("line_no")).cast("string")
    return make_findings(hits.select("repo_id", F.concat_ws(":", "head", "path", line).alias("id"), "title", "severity", F.lit("FLOW").alias("module"), "check", "category", "confidence", F.lit("file").alias("type"), F.col("path").alias("source"), line.alias("location"), words.alias("excerpt")))


def dotenv_findings(files: DataFrame) -> DataFrame:
    """A finding for each repository whose .env at the root looks as if it held a secret."""
    kept = files.where((F.col("path") == ".env") & t.looks_like_secret(F.col("content")))
    # Title and evidence.
    title, words = "Depoda .env dosyası gerçek secret içeriyor olabilir", "secret-benzeri değer tespit edildi (maskeli)"
    named = {"id": "B1-committed-dotenv", "title": title, "severity": "P1", "module": "B", "check": "B1", "category": "Secret", "confidence": "medium", "type": "file", "source": ".env", "excerpt": words}
    return make_findings(kept.select("repo_id", *(F.lit(v).alias(k) for k, v in named.items()), F.lit(None).cast("string").alias("location")))


@dataclass(frozen=True)
class Scanner:
    """A module of a run: which of its own ids it answers for, and its findings of files; active ones need a run's leave."""

    name: str
    findings: Callable[[DataFrame], DataFrame]
    active: bool = False


def scanners() -> list[Scanner]:
    """The modules that come with the engine, in their order."""
    own = [Scanner("B", lambda f: rule_findings(scan.code_files(f), r.SAST).unionByName(dotenv_findings(f))), Scanner("CLOUD", lambda f: rule_findings(scan.iac_files(f), r.CLOUD, "config", 160))]
    own += [Scanner("FLOW", flow_findings)]
    return own + [Scanner(m, lambda f, m=m: module_findings(f, [m])) for m in MODULES]


def run_scan(files: DataFrame, only: list[str] | None = None, extra: tuple[Scanner, ...] = (), active: bool = False) -> DataFrame:
    """All findings of the modules named in ``only`` (or all), and of ``extra`` ones, deduplicated by module.

    Application modules run together, so that a file is read once for all of
    them.  An active scanner is passed over unless ``active``.  No files, or no
    module that applies, give no findings.
    """
    take = lambda n: only is None or n in only
    parts = [s.findings(files) for s in scanners() if s.name not in MODULES and take(s.name)]
    if named := [m for m in MODULES if take(m)]:
        parts.append(module_findings(files, named))
    parts += [s.findings(files) for s in extra if take(s.name) and (active or not s.active)]
    if not parts:
        raise ValueError("no module of that name")
    return union_modules(parts)


def rank_findings(findings: DataFrame, by: tuple[str, ...] = ("repo_id", "id")) -> DataFrame:
    """findings with rank: their number, from 1, in the order of severity, then of ``by``, over all rows; equal rows follow each other.

    Rows are range-partitioned in that order, so that partitions follow each
    other; each is numbered for itself, and the counts of those before it are
    added: one row a partition, which is what is broadcast.
    """
    order = [t.severity_rank(F.col("severity")), *(F.col(c) for c in by)]
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in the lower 33
    dealt = findings.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place.alias("place__"))
    dealt = durable(dealt).withColumn("part__", F.shiftright("place__", 33))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part__").agg(F.count("*").alias("n")).select("part__", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start__"))
    rank = F.col("start__") + F.col("place__").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(starts), "part__").select(*findings.columns, rank.alias("rank"))
