"""Feeds and records that others keep: known-exploited and probable CVEs, waivers, logs of commits, mounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CVE = r"(?i)(CVE-\d{4}-\d{3,7})"


def _items(x: str, of: str) -> object:
    """Elements of a JSON list, which is the document or its field ``of``; null if there is none."""
    whole = F.when(F.ltrim(F.col(x)).startswith("["), F.col(x)).otherwise(F.get_json_object(x, f"$.{of}"))
    return F.from_json(whole, "array<string>")


def kev_feed(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Distinct cve (upper case) of documents: a list of names, a list of objects with cveID, or such a list as vulnerabilities."""
    each = docs.select(F.explode(_items(doc_col, "vulnerabilities")).alias("x"))
    name = F.when(F.col("x").startswith("{"), F.get_json_object("x", "$.cveID")).otherwise(F.col("x"))
    return each.select(F.explode(F.regexp_extract_all(name, F.lit(CVE), 1)).alias("cve")).select(F.upper("cve").alias("cve")).distinct()


def epss_feed(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """cve, score (the largest of a CVE) of documents: a list of objects with cve and epss, such a list as data, or a map; what is no number is left out."""
    listed = docs.select(F.explode(_items(doc_col, "data")).alias("x")).select(F.get_json_object("x", "$.cve").alias("cve"), F.get_json_object("x", "$.epss").alias("score"))
    plain = docs.where(~F.ltrim(F.col(doc_col)).startswith("[") & F.get_json_object(doc_col, "$.data").isNull())
    mapped = plain.select(F.explode(F.from_json(doc_col, "map<string,string>")).alias("cve", "score"))
    both = listed.unionByName(mapped).select(F.upper("cve").alias("cve"), F.expr("try_cast(score AS DOUBLE)").alias("score"))
    return both.where(F.col("cve").rlike(CVE) & F.col("score").isNotNull()).groupBy("cve").agg(F.max("score").alias("score"))


def waiver_records(raw: DataFrame) -> DataFrame:
    """Records (ordinal, fingerprint, check, id, reason, expires) with rejected: why one counts for nothing, null if it does count; blanks are null."""
    names = ("fingerprint", "check", "id", "reason", "expires")
    x = raw.select("ordinal", *(F.nullif(F.trim(n), F.lit("")).alias(n) for n in names))
    why = F.when(F.coalesce("fingerprint", "check", "id").isNull(), "no selector").when(F.col("reason").isNull(), "no reason")
    return x.withColumn("rejected", why)


def added_lines(logs: DataFrame) -> DataFrame:
    """repo_id, commit (12 digits), line of (repo_id, log) texts of commits with their changes: added lines, each under the last commit above it."""
    x = logs.withColumn("part", F.xxhash64("log")).select("repo_id", "part", F.posexplode(F.split("log", "\r?\n", -1)).alias("pos", "raw"))
    head = F.nullif(F.substring(F.regexp_extract("raw", r"^commit\s+([0-9a-f]{7,40})", 1), 1, 12), F.lit(""))
    above = Window.partitionBy("repo_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("commit", F.coalesce(F.last(head, ignorenulls=True).over(above), F.lit("")))
    return x.where("raw LIKE '+%' AND raw NOT LIKE '+++%'").select("repo_id", "commit", F.expr("substring(raw, 2)").alias("line"))


def compose_mounts(entries: DataFrame) -> DataFrame:
    """repo_id, service, source (null if anonymous), target of entries (repo_id, service, entry): short forms with colons, or objects."""
    parts, long = F.split("entry", ":"), F.col("entry").startswith("{")
    source = F.when(long, F.get_json_object("entry", "$.source")).when(F.size(parts) > 1, parts[0])
    target = F.when(long, F.get_json_object("entry", "$.target")).when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(parts[0])
    return entries.select("repo_id", "service", source.alias("source"), target.alias("target")).where("target IS NOT NULL")
