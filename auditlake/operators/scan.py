"""Rule scans over source lines.

All rules of a set are tried in one projection with literal patterns, which are
compiled once, and matches are exploded; file contents never enter a shuffle.
Caps and dedup are windows by file and by fingerprint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import text as t
from auditlake.functions.patterns import has
from auditlake.operators import rules as r
from auditlake.operators.rules import Rule


def code_files(files: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Code files of at most ``limit`` characters outside build, vendor and test folders."""
    return files.where(F.col("path").rlike(r.CODE_FILE) & ~F.col("path").rlike(r.NOT_SCANNED) & (F.length("content") <= limit))


def lines(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no (from 1), line; lines end at \\n or \\r\\n."""
    return files.select("repo_id", "path", F.posexplode(F.split("content", "\r?\n", -1)).alias("pos", "line")).select("repo_id", "path", (F.col("pos") + 1).alias("line_no"), "line")


def matches(of: DataFrame, rules: list[Rule]) -> DataFrame:
    """lines with rule (its number): a row for each rule that a line matches."""

    def hit(i: int, rule: Rule) -> Column:
        ok = F.lit(True)
        if rule.include:
            ok = ok & F.col("path").rlike(rule.include)
        if rule.exclude:
            ok = ok & ~F.col("path").rlike(rule.exclude)
        ok = ok & F.col("line").rlike(rule.pattern)
        if rule.validate:
            ok = ok & rule.validate(F.col("line"))
        return F.when(ok, F.lit(i))

    found = F.filter(F.array(*(hit(i, x) for i, x in enumerate(rules))), lambda x: x.isNotNull())
    return of.select("repo_id", "path", "line_no", "line", F.explode(found).alias("rule"))


def file_matches(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """As matches() of the lines of files, but a rule is tried on lines only if its gates pass, the whole text holds a string that
    its matches need, and has a match.

    Patterns hold for a line by itself and have no lookarounds; so what matches in
    a line matches in the text if ^ and $ stand for any line's ends.  Most files
    have few rules left or none, and only these go on as lines, with the rules as
    bits of a number.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules at once")

    def open_(i: int, rule: Rule) -> Column:
        ok = F.col("path").rlike(rule.include) if rule.include else F.lit(True)
        ok = ok & ~F.col("path").rlike(rule.exclude) if rule.exclude else ok
        return F.when(ok & has(F.col("content"), F.col("low"), rule.pattern, "(?m)"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))

    bits = reduce(lambda a, b: a.bitwiseOR(b), (open_(i, x) for i, x in enumerate(rules)))
    # no filter on the bits: it would be pushed below them, and all rules tried twice; an array that is null gives no rows
    kept = files.select("repo_id", "path", "content", F.lower("content").alias("low")).select("repo_id", "path", "content", bits.alias("bits"))
    held = kept.select("repo_id", "path", "bits", F.posexplode(F.when(F.col("bits") != 0, F.split("content", "\r?\n", -1))).alias("pos", "line")).withColumn("low", F.lower("line"))

    def hit(i: int, rule: Rule) -> Column:
        ok = (F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0) & has(F.col("line"), F.col("low"), rule.pattern)
        return F.when(ok & rule.validate(F.col("line")) if rule.validate else ok, F.lit(i))

    found = F.filter(F.array(*(hit(i, x) for i, x in enumerate(rules))), lambda x: x.isNotNull())
    return held.select("repo_id", "path", (F.col("pos") + 1).alias("line_no"), "line", F.explode(found).alias("rule"))


def described(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """hits with rule_id, module, check, severity, confidence, title, category and cap of their rule."""
    spark = hits.sparkSession
    shape = "rule int, rule_id string, module string, check string, severity string, confidence string, title string, category string, cap int"
    table = spark.createDataFrame([(i, x.id, x.module, x.check, x.severity, x.confidence, x.title, x.category, x.cap) for i, x in enumerate(rules)], shape)
    return hits.join(F.broadcast(table), "rule")  # as many rows as rules


def capped(hits: DataFrame, cap: Column) -> DataFrame:
    """The first hits of each rule and file, in order of lines."""
    w = Window.partitionBy("repo_id", "path", "rule_id").orderBy("line_no")
    return hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def dedup_fingerprint(findings: DataFrame) -> DataFrame:
    """The first finding (by path, line) of each repository and fingerprint."""
    w = Window.partitionBy("repo_id", "fingerprint").orderBy("path", "line_no")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def rule_scan(of: DataFrame, rules: list[Rule] = r.SAST, width: int = 200, masks: int = 2, cap: int | None = None) -> DataFrame:
    """Findings of a rule set over lines, or over files (repo_id, path, content), which is faster: repo_id, path, line_no, id, rule_id, module, check, severity, confidence, title, category, excerpt, fingerprint.

    The cap counts hits before dedup; excerpts are the trimmed line, cut, then
    masked (``masks`` times, as masking once more can shorten further).
    """
    hits = described(file_matches(of, rules) if "content" in of.columns else matches(of, rules), rules)
    hits = capped(hits, F.col("cap") if cap is None else F.lit(cap))
    excerpt = F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, width)
    for _ in range(masks):
        excerpt = t.mask_secrets(excerpt)
    out = hits.select("repo_id", "path", "line_no", F.concat_ws(":", "rule_id", "path", "line_no").alias("id"), "rule_id", "module", "check", "severity", "confidence", "title", "category", excerpt.alias("excerpt"))
    signature = F.concat_ws("|", "path", t.normalize_ws(F.col("excerpt")))
    return dedup_fingerprint(out.withColumn("fingerprint", t.fingerprint(F.col("module"), F.col("check"), F.col("title"), F.array(signature))))


def iac_files(files: DataFrame) -> DataFrame:
    """Infrastructure files outside build, vendor and provider folders."""
    return files.where(F.col("path").rlike(r.IAC_FILE) & ~F.col("path").rlike(r.IAC_SKIP))


def cloud_scan(files: DataFrame) -> DataFrame:
    return rule_scan(iac_files(files), r.CLOUD, width=160, masks=1)


def card_data_scan(of: DataFrame, limit: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, path, line_no, kind (and the columns in ``keep``) of lines that name a card's code or number; whole lines until ``limit`` hits of a repository are reached."""
    kept = of.where(F.col("path").rlike(r.CODE_OR_SCHEMA) & ~F.col("path").rlike(r.CARD_SKIP))
    kinds = F.filter(F.array(F.when(F.col("line").rlike(r.CVV), "cvv"), F.when(F.col("line").rlike(r.PAN), "pan")), lambda x: x.isNotNull())
    held = kept.select("repo_id", "path", "line_no", *keep, kinds.alias("kinds")).where(F.size("kinds") > 0)
    before = Window.partitionBy("repo_id").orderBy("path", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("n", F.coalesce(F.sum(F.size("kinds")).over(before), F.lit(0))).where(F.col("n") < limit)
    return held.select("repo_id", "path", "line_no", *keep, F.explode("kinds").alias("kind"))


def local_webhooks(of: DataFrame) -> DataFrame:
    """repo_id, path, line_no, url of configuration lines that send a webhook to this machine or a tunnel."""
    kept = of.where(F.col("path").rlike(r.CONFIG_FILE) & F.col("line").rlike(r.WEBHOOK_KEY) & F.col("line").rlike(r.LOCAL_URL))
    return kept.select("repo_id", "path", "line_no", F.regexp_extract("line", r.LOCAL_URL, 1).alias("url"))


def history_secrets(added: DataFrame) -> DataFrame:
    """repo_id, commit, pattern, excerpt of added lines (repo_id, commit, line) that hold a secret which is no placeholder."""
    hit = lambda p: (F.col("line").rlike(p)) & ~F.regexp_extract("line", f"({p})", 1).rlike(r.PLACEHOLDER)
    found = F.filter(F.array(*(F.when(hit(p), n) for n, p in r.HISTORY)), lambda x: x.isNotNull())
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    out = added.select("repo_id", "commit", F.explode(found).alias("pattern"), trimmed.alias("line")).distinct()
    return out.select("repo_id", "commit", "pattern", t.mask_secrets(F.substring("line", 1, 160)).alias("excerpt"))


def signal_flags(files: DataFrame, signals: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row a repository with a boolean a signal: whether any file matches it, without comments if the signal says so.

    One aggregate with partial results for all signals, so that a repository of any size is one small row a task.
    """
    stripped = files.withColumn("__code", t.strip_comments(F.col("content")))
    return stripped.groupBy("repo_id").agg(*(F.coalesce(F.bool_or(F.col("__code" if bare else "content").rlike(p)), F.lit(False)).alias(n) for n, (p, bare) in signals.items()))


def absence_findings(flags: DataFrame, checks: list[tuple[str, str, str, str]]) -> DataFrame:
    """repo_id, check, severity for (check, severity, surface, control): repositories that have the surface signal and lack the control."""
    found = F.filter(F.array(*(F.when(F.col(s) & ~F.col(c), F.struct(F.lit(n).alias("check"), F.lit(v).alias("severity"))) for n, v, s, c in checks)), lambda x: x.isNotNull())
    return flags.select("repo_id", F.explode(found).alias("f")).select("repo_id", "f.*")
