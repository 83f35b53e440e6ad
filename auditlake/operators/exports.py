"""Exports of findings: playbook, history, SARIF documents, report rows, log of a run; dependencies from manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import mask_secrets, severity_rank
from auditlake.operators.rules import RISK_BY_SEVERITY
from auditlake.sources.shared import durable

# Score of a finding that has none.
SECURITY = {"P0": 9.0, "P1": 7.0, "P2": 4.0, "P3": 1.0}
#: Findings that a task of an export gets, and repositories up to which their counts are broadcast.
TASK, BROADCAST = 50_000, 500_000


def risk_text(cvss: Column, severity: Column, exploitability: Column) -> Column:
    """CVSS score, or the severity without one, and how exploitable it is, if that is known."""
    score = F.coalesce(F.concat(F.lit("CVSS "), F.format_string("%.1f", cvss)), severity)
    return F.concat(F.when(cvss.isNull(), severity).otherwise(score), F.coalesce(F.concat(F.lit(" / exploitability "), exploitability), F.lit("")))


def playbook(findings: DataFrame) -> DataFrame:
    """repo_id, id, severity, risk of P0 and P1 findings: the score, or the severity, with how exploitable it is."""
    risk = risk_text(F.col("cvss"), F.col("severity"), F.col("exploitability"))
    return findings.where(F.col("severity").isin("P0", "P1")).select("repo_id", "id", "severity", risk.alias("risk"))


def prompt_select(findings: DataFrame, modules: list[str] | None = None, severities: tuple[str, ...] = ("P0", "P1"), fingerprints: DataFrame | None = None) -> DataFrame:
    """findings of these modules (all, if not given), severities and (repo_id, fingerprint) rows (all, if not given)."""
    out = findings.where(F.col("severity").isin(*severities))
    out = out.where(F.col("module").isin(*modules)) if modules else out
    return out.join(fingerprints.select("repo_id", "fingerprint").distinct(), ["repo_id", "fingerprint"], "left_semi") if fingerprints is not None else out


# The lines of a prompt, as (name that must be there or "", text).
PROMPT = [
    ("", "```text"), ("", "Görev: Aşağıdaki güvenlik bulgusunu düzelt."), ("", "Bulgu: {title}"), ("", "Şiddet/Risk: {severity} · {risk} · güven: {confidence}"), ("", "Kategori/Kontrol: {category} ({check})"), ("standards", "Standart: {standards}"), ("impact", "Etki: {impact}"),
    ("", "Etkilenen konum(lar):"), ("", "{places}"), ("", "Adımlar:"), ("", "  1) Yukarıdaki konum(lar)ı aç ve sorunu doğrula."), ("recommendation", "  2) Şu yaklaşımı uygula: {recommendation}"), ("", "  3) Aynı sınıftaki diğer örnekleri de tara (grep ile yaygınlaştır)."),
    ("", "Test/Kabul:"), ("", "  - İlgili birim/entegrasyon testini ekle/güncelle; regresyon olmamalı."), ("", "  - Yeniden çalıştır: bu bulgu (`{id}`) \"düzeltilen\"e geçmeli (öncesi/sonrası delta)."), ("", "```"),
]


def prompts(findings: DataFrame) -> DataFrame:
    """repo_id, id, fingerprint, severity, title, risk, category, check, locations, confidence, text: a finding as a task to hand over.

    Findings are of run_scan(); cvss, exploitability, impact, recommendation and
    references are taken where there are such columns, and lines that need one
    that is missing or null are left out.  Impact and recommendation are masked.
    """
    none = F.lit(None).cast("string")
    has = lambda c, to=none: F.col(c) if c in findings.columns else to
    place = F.concat("source", F.coalesce(F.concat(F.lit(":"), F.nullif("location", F.lit(""))), F.lit("")))
    standards = F.nullif(F.array_join(has("references", F.array().cast("array<string>")), ", "), F.lit(""))
    known = findings.select("*", risk_text(has("cvss", F.lit(None).cast("double")), F.col("severity"), has("exploitability")).alias("risk__"), place.alias("place__"), standards.alias("standards__"))
    words = {"risk": F.col("risk__"), "places": F.concat(F.lit("  - "), F.coalesce("place__", F.lit("(rapora bakın)"))), "standards": F.col("standards__"), "impact": mask_secrets(has("impact")), "recommendation": mask_secrets(has("recommendation"))}

    def line(need: str, form: str) -> Column:
        parts = re.split(r"\{(\w+)\}", form)
        text = F.concat(*(F.coalesce(words.get(x, F.col(x) if i % 2 else None), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))
        return F.when(words[need].isNotNull(), text) if need else text

    text = F.array_join(F.array_compact(F.array(*(line(*x) for x in PROMPT))), "\n")
    return known.select("repo_id", "id", "fingerprint", "severity", "title", F.col("risk__").alias("risk"), "category", "check", F.array_compact(F.array("place__")).alias("locations"), "confidence", text.alias("text"))


def history_runs(findings: DataFrame, changes: DataFrame, scores: DataFrame, run: str, generated_at: Column) -> DataFrame:
    """history_rows() with run, generated_at, overall_score and parity_score (scores has repo_id and these two; null without)."""
    counts = ["total", "p0", "p1", "p2", "p3", "fixed", "introduced", "persisting"]
    rows = scores.join(history_rows(findings, changes), "repo_id", "left").fillna(0, counts)
    return rows.select("repo_id", F.lit(run).alias("run"), generated_at.alias("generated_at"), "overall_score", "parity_score", *counts)


def append_history(rows: DataFrame, path: str) -> None:
    """Add a run's rows to a history; a run that is written again replaces its own rows and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def history_rows(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """repo_id, total, p0..p3, fixed, introduced, persisting: the trend row of a run."""
    now = findings.groupBy("repo_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in RISK_BY_SEVERITY))
    moved = changes.groupBy("repo_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("fixed", "introduced", "persisting")))
    return now.join(moved, "repo_id", "left").fillna(0, ["fixed", "introduced", "persisting"])


def export_sarif(findings: DataFrame) -> DataFrame:
    """repo_id, part, doc: SARIF runs of at most about 10,000 results, with a rule for each check that they name.

    Findings have repo_id, id, severity and fingerprint; check, module, title,
    confidence, cvss, path, line and references (a list) are taken where there are
    such columns.  The first finding of a check, by severity and id, gives its
    rule.  security-severity is the score, or 9, 7, 4 and 1 by severity.  A
    repository of any size is cut by a hash of the finding into documents that
    fit into memory; results are in order of severity and id.

    Findings are counted by repository first, and dealt out once, as they are, to
    tasks of about TASK findings; texts are made behind that, a result for itself,
    and a document joins them.
    """
    level = F.when(F.col("severity").isin("P0", "P1"), "error").when(F.col("severity") == "P2", "warning").otherwise("note")
    has = lambda c, other: F.col(c) if c in findings.columns else other
    none = F.lit(None).cast("string")
    check, title = F.coalesce(has("check", none), "id"), mask_secrets(F.coalesce(has("title", none), "id"))
    score = F.coalesce(has("cvss", F.lit(None).cast("double")), *(F.when(F.col("severity") == s, x) for s, x in SECURITY.items()))
    counts = durable(findings.groupBy("repo_id").agg(F.count("*").alias("n")))
    total = counts.agg(F.count("*").alias("repos"), F.sum("n").alias("n")).first()
    size = counts.select("repo_id", F.ceil(F.col("n") / 10_000).cast("int").alias("parts"))
    size = F.broadcast(size) if total["repos"] <= BROADCAST else size
    used = [c for c in ("repo_id", "id", "severity", "fingerprint", "check", "module", "title", "confidence", "cvss", "path", "line", "references") if c in findings.columns]
    cut = findings.select(*used).join(size, "repo_id").withColumn("part", F.pmod(F.xxhash64("id", "fingerprint"), F.col("parts")).cast("int")).drop("parts")
    cut = cut.repartition(max(1, -(-(total["n"] or 0) // TASK)), "repo_id", "part")
    place = F.struct(F.struct(F.struct(F.coalesce(has("path", none), F.lit("unknown")).alias("uri")).alias("artifactLocation"), F.when(has("line", F.lit(None).cast("int")) > 0, F.struct(has("line", F.lit(None).cast("int")).alias("startLine"))).alias("region")).alias("physicalLocation"))
    properties = F.struct(F.col("severity"), F.format_string("%.1f", score).alias("security-severity"), has("confidence", none).alias("confidence"), F.col("id").alias("findingId"))
    text = F.struct(F.concat(F.lit("["), F.col("severity"), F.lit("] "), title).alias("text"))
    result = F.struct(check.alias("ruleId"), level.alias("level"), text.alias("message"), F.struct(F.col("fingerprint").alias("auditlake")).alias("partialFingerprints"), properties.alias("properties"), F.array(place).alias("locations"))
    tags = F.concat(F.array_compact(F.array(has("module", none))), F.coalesce(has("references", F.array().cast("array<string>")), F.array().cast("array<string>")))
    rule = F.struct(check.alias("id"), F.concat_ws("-", has("module", none), check).alias("name"), F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(tags.alias("tags")).alias("properties"))
    # the parts are whole in a task already, so neither the window nor the groups shuffle
    nth = F.row_number().over(Window.partitionBy("repo_id", "part", check).orderBy("severity", "id", "fingerprint"))
    told = cut.withColumn("nth__", nth).select("repo_id", "part", F.struct("severity", "id", "fingerprint", F.to_json(result).alias("text")).alias("r"), F.when(F.col("nth__") == 1, F.struct(check.alias("check"), F.to_json(rule).alias("text"))).alias("rule"))
    by = told.groupBy("repo_id", "part").agg(F.collect_list("r").alias("r"), F.collect_list("rule").alias("rules"))
    # sort_array compares the fields as they stand, many times faster than array_sort, whose order is an expression
    texts = lambda c: F.array_join(F.sort_array(c)["text"], ",")
    doc = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"auditlake","rules":['), texts("rules"), F.lit(']}},"results":['), texts("r"), F.lit("]}]}"))
    return by.select("repo_id", "part", doc.alias("doc"))


def report_rows(findings: DataFrame) -> DataFrame:
    """repo_id, rank, id, place, location, excerpt: findings with each piece of evidence (type, source, location, excerpt), masked; one row without any."""
    x = findings.select("repo_id", severity_rank(F.col("severity")).alias("rank"), "id", F.posexplode_outer("evidence").alias("place", "e"))
    at = F.when(F.col("e.location") != "", F.concat("e.source", F.lit(":"), "e.location")).otherwise(F.col("e.source"))
    return x.select("repo_id", "rank", "id", "place", at.alias("location"), mask_secrets(F.col("e.excerpt")).alias("excerpt"))


def run_events(events: DataFrame) -> DataFrame:
    """ts, kind, message of a run's log (ts, kind, message, target): secrets masked, a command with its target."""
    said = F.when((F.col("kind") == "CMD") & F.col("target").isNotNull(), F.concat("message", F.lit("  → target="), "target")).otherwise(F.col("message"))
    return events.where(F.col("kind").isin("INFO", "AUTHZ", "CMD", "WARN")).select("ts", "kind", mask_secrets(said).alias("message"))


def write_findings(findings: DataFrame, path: str, keys: tuple[str, ...] = ("repo_id", "scan_id")) -> None:
    """Append findings to a table by repository and scan, in each file by severity and id."""
    rank = severity_rank(F.col("severity"))
    findings.sortWithinPartitions(*keys, rank, "id").write.mode("append").partitionBy(*keys).parquet(path)


def top_evidence(findings: DataFrame, few: int = 5) -> DataFrame:
    """repo_id, check, hits, evidence: how often a check hit, and its first places (path, line_no) in order."""
    w = Window.partitionBy("repo_id", "check").orderBy("path", "line_no")
    first = findings.select("repo_id", "check", "path", "line_no").withColumn("n", F.row_number().over(w)).where(F.col("n") <= few)
    named = first.groupBy("repo_id", "check").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "path", "line_no").alias("at")))), lambda x: x["at"]).alias("evidence"))
    return findings.groupBy("repo_id", "check").agg(F.count("*").alias("hits")).join(named, ["repo_id", "check"])


def _json_names(*paths: str) -> Column:
    """Names in the objects at these paths of a JSON text."""
    none = F.array().cast("array<string>")
    return F.concat(*(F.coalesce(F.json_object_keys(F.get_json_object("content", p)), none) for p in paths))


def named_deps(path: Column) -> Column:
    """Array of the dependencies that a manifest names, by its path: package.json, requirements.txt, pyproject.toml, composer.json, go.mod, project files; lower case but for npm, null for other files."""
    low = lambda a: F.transform(a, F.lower)
    found = lambda p: F.regexp_extract_all("content", F.lit(p), 1)
    pip = F.transform(F.filter(F.split("content", "\r?\n"), lambda x: ~F.ltrim(x).startswith("#") & (F.trim(x) != "")), lambda x: F.regexp_extract(F.trim(x), r"^([^=<>!~;\[\s]*)", 1))
    toml = F.concat(found(r"""(?m)^\s*["']?([A-Za-z0-9_.-]+)["']?\s*=\s*["']"""), found(r"""["']([A-Za-z0-9_.-]+)\s*[><=~]"""))
    return (
        F.when(path.rlike(r"(^|/)package\.json$"), _json_names("$.dependencies", "$.devDependencies")).when(path.rlike(r"(^|/)composer\.json$"), low(_json_names("$.require", "$['require-dev']")))
        .when(path.rlike(r"(^|/)requirements\.txt$"), low(pip)).when(path.rlike(r"(^|/)pyproject\.toml$"), low(toml)).when(path.rlike(r"(^|/)go\.mod$"), low(found(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v")))
        .when(path.rlike(r"\.csproj$"), low(found(r'<PackageReference\s+Include="([^"]+)"')))
    )


def manifest_deps(files: DataFrame) -> DataFrame:
    """Distinct repo_id, dep that manifests name, at any depth."""
    return files.select("repo_id", F.explode(named_deps(F.col("path"))).alias("dep")).where("dep != ''").distinct()


def dependency_presence(deps: DataFrame, names: list[str]) -> DataFrame:
    """repo_id, present: whether a dependency is, or begins with, one of the names."""
    hit = F.exists(F.lit(names), lambda n: F.startswith(F.col("dep"), n))
    return deps.groupBy("repo_id").agg(F.bool_or(hit).alias("present"))
