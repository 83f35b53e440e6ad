"""Results of other tools as findings: SARIF, OSV, npm audit, Nuclei; JSON text that cannot be read gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as t

_SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,properties:struct<`security-severity`:string,tags:array<string>>>>>>,"
    "results:array<struct<ruleId:string,rule:struct<id:string>,ruleIndex:int,level:string,message:struct<text:string>,properties:struct<`security-severity`:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
)
# Which module answers for a tool's findings, the first that fits; else B.
TOOLS = [("checkov|tfsec|kics|terrascan|cloudsploit|prowler", "CLOUD"), ("kubescape|kube-bench|kubeaudit|polaris", "K8S"), ("nuclei|zap|nikto|wapiti|arachni", "C")]


def infer_module(tool: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(tool).rlike(p), m) for p, m in TOOLS), F.lit("B"))


def sarif(reports: DataFrame) -> DataFrame:
    """repo_id, id, title, check, severity, module, source, line, excerpt, references, cves of reports (repo_id, doc): a row a result.

    A result's rule is its ruleId, else the id of its rule, else ``rule``, and
    is looked up by id, else by index.  Severity is the result's or the rule's
    security-severity, else the level (warning if there is none).  The id tells
    tool, rule and place, so that hits of one rule differ.
    """
    runs = reports.select("repo_id", F.explode(F.from_json("doc", _SARIF)["runs"]).alias("r"))
    res = runs.select("repo_id", F.coalesce("r.tool.driver.name", F.lit("external")).alias("tool"), F.col("r.tool.driver.rules").alias("rules"), F.explode("r.results").alias("x"))
    res = res.withColumn("name", F.coalesce("x.ruleId", "x.rule.id", F.lit("rule")))
    by_id = F.get(F.filter("rules", lambda q: q["id"] == F.col("name")), F.lit(0))
    res = res.withColumn("rule", F.coalesce(by_id, F.when(F.col("x.ruleIndex") >= 0, F.get("rules", F.col("x.ruleIndex")))))
    score = F.coalesce(F.col("x.properties.security-severity"), F.col("rule.properties.security-severity")).try_cast("double")
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    uri, line = F.coalesce(place["artifactLocation"]["uri"], F.lit("")), place["region"]["startLine"]
    said = F.coalesce("x.message.text", "name")
    base = t.sanitize_id(F.concat(F.lit("EXT-"), "tool", F.lit("-"), "name"), 80)
    check = t.sanitize_id(F.col("name"), 40)
    return res.select(
        "repo_id", F.concat_ws(":", base, F.when(uri != "", uri).otherwise("n-a"), F.coalesce(line.cast("string"), F.lit("0"))).alias("id"), F.concat(F.lit("["), "tool", F.lit("] "), "name").alias("title"), F.when(check != "", check).otherwise("EXT").alias("check"),
        F.when(score.isNotNull(), t.sev_from_score(score)).otherwise(t.sev_from_level(F.col("x.level"))).alias("severity"), infer_module(F.col("tool")).alias("module"),
        F.when(uri != "", uri).otherwise(F.col("tool")).alias("source"), line.alias("line"), t.mask_secrets(F.substring(said, 1, 200)).alias("excerpt"),
        F.concat(F.array("tool"), F.coalesce("rule.properties.tags", F.array().cast("array<string>"))).alias("references"), F.array_join(t.extract_cves(F.concat_ws(" ", "name", said)), ",").alias("cves"),
    )


_OSV = "results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<struct<id:string,aliases:array<string>,severity:array<struct<type:string,score:string>>,database_specific:struct<severity:string>>>>>>>"


def osv(reports: DataFrame) -> DataFrame:
    """repo_id, id, severity, cves of reports (repo_id, doc): a numeric score, else P2 if there is a vector, else the database's label, else P2."""
    x = reports.select("repo_id", F.explode(F.from_json("doc", _OSV)["results"]).alias("r")).select("repo_id", F.explode("r.packages").alias("p")).select("repo_id", F.col("p.package.name").alias("pkg"), F.explode("p.vulnerabilities").alias("v"))
    given = F.get("v.severity", F.lit(0))["score"]
    label = F.col("v.database_specific.severity")
    severity = F.when(given.try_cast("double").isNotNull(), t.sev_from_score(given.try_cast("double"))).when(given.isNotNull() | label.isNull(), "P2").otherwise(t.sev_from_label(label))
    return x.select("repo_id", F.concat_ws(":", F.lit("B2-osv"), "pkg", "v.id").alias("id"), severity.alias("severity"), F.array_join(t.extract_cves(F.concat_ws(" ", "v.id", F.array_join("v.aliases", " "))), ",").alias("cves"))


def npm_audit(reports: DataFrame) -> DataFrame:
    """repo_id, id, severity, title, excerpt of reports (repo_id, doc) of either version: the map of vulnerabilities, else that of advisories.

    The excerpt names package, range and the first title that tells why.
    """
    shape = "vulnerabilities map<string,struct<severity:string,range:string,via:array<string>>>, advisories map<string,struct<module_name:string,severity:string,title:string,vulnerable_versions:string>>"
    v = reports.select("repo_id", F.from_json("doc", shape).alias("d"))
    # what a vulnerability comes by is a name or an object, which stays text here
    why = lambda x: F.get(F.filter(F.transform(F.coalesce(x["via"], F.array().cast("array<string>")), lambda y: F.when(y.startswith("{"), F.coalesce(F.get_json_object(y, "$.title"), F.lit("")))), lambda y: y.isNotNull()), F.lit(0))
    new = v.where("d.vulnerabilities IS NOT NULL").select("repo_id", F.explode("d.vulnerabilities").alias("pkg", "x")).where("x IS NOT NULL")
    new = new.select("repo_id", "pkg", F.coalesce("x.severity", F.lit("low")).alias("severity"), F.coalesce(F.nullif(why(F.col("x")), F.lit("")), F.concat("pkg", F.lit(" zafiyeti"))).alias("why"), F.nullif("x.range", F.lit("")).alias("range"))
    old = v.where("d.vulnerabilities IS NULL AND d.advisories IS NOT NULL").select("repo_id", F.explode("d.advisories").alias("k", "x")).where("x IS NOT NULL")
    old = old.select("repo_id", F.coalesce("x.module_name", F.lit("?")).alias("pkg"), F.coalesce("x.severity", F.lit("low")).alias("severity"), F.coalesce("x.title", F.lit("zafiyet")).alias("why"), F.nullif("x.vulnerable_versions", F.lit("")).alias("range"))
    label = F.lower("severity")
    rank = F.when(label == "critical", "P0").when(label == "high", "P1").when(label == "moderate", "P2").when(label.isin("low", "info"), "P3").otherwise("P2")
    title = F.concat(F.lit("Zafiyetli bağımlılık: "), "pkg", F.lit(" ("), "severity", F.lit(")"))
    excerpt = F.substring(F.concat("pkg", F.coalesce(F.concat(F.lit(" "), "range"), F.lit("")), F.lit(": "), "why"), 1, 200)
    return new.unionByName(old).select("repo_id", F.concat(F.lit("B2-vuln:"), "pkg").alias("id"), rank.alias("severity"), title.alias("title"), excerpt.alias("excerpt"))


def nuclei(lines: DataFrame) -> DataFrame:
    """repo_id, id, title, check, severity, source, references of JSON lines (repo_id, line); lines that are no object are skipped."""
    shape = "`template-id` string, info struct<name:string,severity:string,reference:array<string>>, `matched-at` string, host string"
    x = lines.where(F.ltrim("line").startswith("{") & F.try_parse_json("line").isNotNull()).select("repo_id", F.from_json("line", shape).alias("d"))
    label = F.lower("d.info.severity")
    severity = F.when(label == "critical", "P0").when(label == "high", "P1").when(label == "medium", "P2").otherwise("P3")
    template, there = F.col("d.template-id"), F.coalesce("d.matched-at", "d.host", F.lit(""))
    return x.select(
        "repo_id", F.substring(F.concat(F.lit("EXT-nuclei-"), F.coalesce(template, F.lit("t")), F.lit(":"), there), 1, 90).alias("id"), F.concat(F.lit("[nuclei] "), F.coalesce("d.info.name", template, F.lit("nuclei finding"))).alias("title"),
        F.coalesce(template, F.lit("nuclei")).alias("check"), severity.alias("severity"), F.when(there != "", there).otherwise("target").alias("source"), F.concat(F.array(F.lit("nuclei")), F.coalesce("d.info.reference", F.array().cast("array<string>"))).alias("references"),
    )
