"""Enrichment of findings: risk, known-exploited and probable CVEs, reachability, waivers, delta."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as t
from auditlake.operators import rules as r


def risk(id_: Column, severity: Column) -> tuple[Column, Column]:
    """(cvss, exploitability): of the first prefix that the id starts with, else of the severity."""
    score = when = None
    for prefix, cvss, level in r.RISK:
        score = F.when(id_.startswith(prefix), cvss) if score is None else score.when(id_.startswith(prefix), cvss)
        when = F.when(id_.startswith(prefix), level) if when is None else when.when(id_.startswith(prefix), level)
    for severity_, (cvss, level) in r.RISK_BY_SEVERITY.items():
        score, when = score.when(severity == severity_, cvss), when.when(severity == severity_, level)
    return score, when


def risk_enrich(findings: DataFrame) -> DataFrame:
    """findings with cvss and exploitability; what a finding brings itself stays."""
    score, level = risk(F.col("id"), F.col("severity"))
    own = set(findings.columns)
    return findings.withColumn("cvss", F.coalesce("cvss", score) if "cvss" in own else score).withColumn("exploitability", F.coalesce("exploitability", level) if "exploitability" in own else level)


def kev_epss_enrich(findings: DataFrame, kev: DataFrame, epss: DataFrame, key: list[str]) -> DataFrame:
    """findings (with cves, exploitability) with kev, epss and exploitability.

    kev: any CVE is listed; epss: the largest score; exploitability is high if
    kev, or if epss is 0.5 or more.  Both feeds are joined by CVE, which Spark
    broadcasts only if they are small; only key and CVE are shuffled.
    """
    known = kev.select(F.upper("cve").alias("__cve")).distinct().withColumn("listed", F.lit(True))
    likely = epss.groupBy(F.upper("cve").alias("__cve")).agg(F.max("score").alias("score"))
    by = findings.select(*key, F.explode("cves").alias("__cve")).join(known, "__cve", "left").join(likely, "__cve", "left")
    found = by.groupBy(*key).agg(F.coalesce(F.bool_or("listed"), F.lit(False)).alias("kev"), F.max("score").alias("epss"))
    out = findings.join(found, key, "left").withColumn("kev", F.coalesce("kev", F.lit(False)))
    return out.withColumn("exploitability", F.when(F.col("kev") | (F.coalesce("epss", F.lit(0.0)) >= 0.5), "high").otherwise(F.col("exploitability")))


# The forms in which packages are imported.
IMPORTS = [
    r"""(?m)\bfrom\s+['"]([^'".][^'"]*)['"]""",
    r"""\brequire\(\s*['"]([^'".][^'"]*)['"]\s*\)""",
    r"""\bimport\(\s*['"]([^'".][^'"]*)['"]\s*\)""",
    r"""(?m)^\s*import\s+['"]([^'".][^'"]*)['"]""",
]
GO_IMPORTS = [r'(?m)^\s*(?:import\s+)?(?:[A-Za-z_.]+\s+)?"([a-z0-9.-]+\.[a-z]+/[^"\s]+)"\s*$']
PY_IMPORTS = [r"(?m)^\s*import\s+([A-Za-z_][\w]*)", r"(?m)^\s*from\s+([A-Za-z_][\w]*)[\w.]*\s+import\b"]


def import_graph(files: DataFrame) -> DataFrame:
    """Distinct repo_id, pkg that files import: four forms in JavaScript, two in Python, and Go's paths with a domain."""
    script = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), 1) for p in IMPORTS)))
    python = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), 1) for p in PY_IMPORTS)))
    go = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), 1) for p in GO_IMPORTS)))
    got = F.when(F.col("path").rlike(r"\.py$"), python).when(F.col("path").rlike(r"\.go$"), go).when(F.col("path").rlike(r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|vue)$"), F.transform(script, t.pkg_root)).otherwise(F.array().cast("array<string>"))
    return files.select("repo_id", F.explode(got).alias("pkg")).distinct()


def package_of(id_: Column) -> Column:
    """The package of a dependency finding's id, null for others."""
    found = F.regexp_extract(id_, r"^B2-(?:vuln:(.+)|osv:((?:@[^:/]+/)?[^:]+):.*)$", 1)
    other = F.regexp_extract(id_, r"^B2-(?:vuln:(.+)|osv:((?:@[^:/]+/)?[^:]+):.*)$", 2)
    return F.nullif(F.concat(found, other), F.lit(""))


def reachability_enrich(findings: DataFrame, imports: DataFrame) -> DataFrame:
    """findings (repo_id, id, kev, exploitability) with reachable: null for what is no dependency or a repository without imports.

    A package is reachable if it is imported, or one of the two is a path above
    the other: imports are expanded to the paths above them and packages to
    theirs, so both are equi-joins.  What is not reachable and not known to be
    exploited has low exploitability.
    """
    marked = findings.withColumn("pkg", package_of(F.col("id")))
    graphs = imports.select("repo_id").distinct().withColumn("known", F.lit(True))
    parts = F.split("pkg", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    below = imports.select("repo_id", F.explode(ups).alias("pkg")).distinct().withColumn("hit", F.lit(True))
    above = marked.where("pkg IS NOT NULL").select("repo_id", "pkg").distinct().select("repo_id", F.col("pkg").alias("of"), F.explode(ups).alias("pkg"))
    above = above.join(imports.select("repo_id", "pkg").distinct(), ["repo_id", "pkg"], "left_semi").select("repo_id", F.col("of").alias("pkg")).distinct().withColumn("hit_above", F.lit(True))
    out = marked.join(graphs, "repo_id", "left").join(below, ["repo_id", "pkg"], "left").join(above, ["repo_id", "pkg"], "left")
    reach = F.when(F.col("pkg").isNotNull() & F.col("known"), F.coalesce("hit", "hit_above", F.lit(False)))
    out = out.withColumn("reachable", reach).drop("known", "hit", "hit_above", "pkg")
    return out.withColumn("exploitability", F.when(~F.coalesce("reachable", F.lit(True)) & ~F.col("kev"), "low").otherwise(F.col("exploitability")))


def waiver_partition(findings: DataFrame, waivers: DataFrame, today: str, key: list[str]) -> DataFrame:
    """findings with reason: of the first (by ordinal) waiver in force all of whose selectors match; null is active.

    Selectors are fingerprint, check and id, of which at least one is given.  A
    waiver without a fingerprint is matched by check or id, so each kind of
    selector is an equi-join of its own; ``today`` compares as text.
    """
    live = waivers.where((F.col("expires").isNull() | (F.col("expires") >= today)) & (F.length("reason") > 0))
    live = live.select("ordinal", "reason", *(F.col(c).alias(f"w_{c}") for c in ("fingerprint", "check", "id")))
    f = findings.select(*key, *[c for c in ("fingerprint", "check", "id") if c not in key])
    fits = lambda c: F.col(f"w_{c}").isNull() | (F.col(f"w_{c}") == F.col(c))
    parts = [
        f.join(live.where("w_fingerprint IS NOT NULL"), F.col("fingerprint") == F.col("w_fingerprint")).where(fits("check") & fits("id")),
        f.join(live.where("w_fingerprint IS NULL AND w_id IS NOT NULL"), F.col("id") == F.col("w_id")).where(fits("check")),
        f.join(live.where("w_fingerprint IS NULL AND w_id IS NULL AND w_check IS NOT NULL"), F.col("check") == F.col("w_check")),
    ]
    met = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = met.groupBy(*key).agg(F.min_by("reason", "ordinal").alias("reason"))
    back = first.select(*(F.col(k).alias(f"back_{k}") for k in key), "reason")
    same = reduce(lambda a, b: a & b, (findings[k].eqNullSafe(back[f"back_{k}"]) for k in key))  # a key column may be null
    return findings.join(back, same, "left").drop(*(f"back_{k}" for k in key))


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """Findings with change: fixed (before only), introduced (now only), persisting; by repository and fingerprint, duplicates stay."""
    by = ["repo_id", "fingerprint"]
    fixed = before.join(now.select(*by).distinct(), by, "left_anti").withColumn("change", F.lit("fixed"))
    new = now.join(before.select(*by).distinct().withColumn("old", F.lit(True)), by, "left").withColumn("change", F.when(F.col("old"), "persisting").otherwise("introduced")).drop("old")
    return fixed.unionByName(new)
