"""Parity checks: what runs against what is written down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import days_until, round1
from auditlake.sources import documents

# What a finding costs its layer.
LAYER_COST = {"P0": 6.0, "P1": 2.5, "P2": 1.0}


def git_parity(state: DataFrame) -> DataFrame:
    """repo_id, drift, dirty, score, status of (repo_id, head_sha, main_sha, behind, dirty_files): 6 off for drift, 2.5 for changed files."""
    drift = (F.col("behind") > 0) & (F.col("head_sha") != F.col("main_sha"))
    dirty = F.col("dirty_files") > 0
    score = 10.0 - F.when(drift, 6.0).otherwise(0.0) - F.when(dirty, 2.5).otherwise(0.0)
    return state.select("repo_id", drift.alias("drift"), dirty.alias("dirty"), score.alias("score"), layer_status(score).alias("status"))


def layer_status(score: Column) -> Column:
    return F.when(score >= 9.5, "ok").when(score >= 6, "warn").otherwise("risk")


def cert_expiry(certs: DataFrame, now: Column) -> DataFrame:
    """source, days, severity of certificates (source, not_after) that have expired (P0) or do so within 14 days (P1)."""
    days = days_until(F.col("not_after"), now)
    return certs.select("source", days.alias("days")).withColumn("severity", F.when(F.col("days") < 0, "P0").when(F.col("days") < 14, "P1")).where("severity IS NOT NULL")


def runtime_freshness(containers: DataFrame, now: Column) -> DataFrame:
    """name, severity, reason: containers (name, state, created_at) that restart or are unhealthy (P1) or are older than 14 days (P2)."""
    bad = F.when(F.col("state").isin("restarting", "unhealthy"), F.struct(F.lit("P1").alias("severity"), F.lit("state").alias("reason")))
    old = F.when(days_until(now, F.col("created_at")) > 14, F.struct(F.lit("P2").alias("severity"), F.lit("age").alias("reason")))
    return containers.select("name", F.explode(F.filter(F.array(bad, old), lambda x: x.isNotNull())).alias("f")).select("name", "f.*")


# What the target of a mount is called where it holds data.
DATA_LIKE = "(?i)uploads|data|storage|files|media|shared|bucket|documents|assets"


def volume_mismatch(mounts: DataFrame) -> DataFrame:
    """repo_id, key, services, pairs of data-like mounts (repo_id, service, source, target) whose name several services map differently.

    The whole target is tried, the key is its last part; a null source is an
    anonymous volume, and one of the ways to map.
    """
    m = mounts.where(F.col("target").rlike(DATA_LIKE)).withColumn("key", F.lower(F.regexp_extract("target", r"([^/]*)/*$", 1)))
    pair = F.struct(F.coalesce("source", F.lit("<anon>")), "target")
    by = m.groupBy("repo_id", "key").agg(F.countDistinct("service").alias("services"), F.countDistinct(pair).alias("pairs"))
    return by.where("services >= 2 AND pairs >= 2")


def env_parity(example: DataFrame, env: DataFrame) -> DataFrame:
    """repo_id, missing, keys: how many of the example's keys (repo_id, key) the environment lacks, and the first eight of them; keys that the example repeats count as often."""
    gone = example.join(env.select("repo_id", "key").distinct(), ["repo_id", "key"], "left_anti")
    return gone.groupBy("repo_id").agg(F.count("*").alias("missing"), F.array_join(F.slice(F.array_sort(F.collect_list("key")), 1, 8), ",").alias("keys"))


def parity_layers(findings: DataFrame) -> DataFrame:
    """repo_id, layer, score, status of findings (repo_id, layer, severity): 10 less their costs, 0 at least."""
    cost = F.lit(0.0)
    for s, c in LAYER_COST.items():
        cost = F.when(F.col("severity") == s, c).otherwise(cost)
    out = findings.groupBy("repo_id", "layer").agg(round1(F.greatest(F.lit(0.0), 10 - F.sum(cost))).alias("score"))
    return out.withColumn("status", layer_status(F.col("score")))


# Kinds that hold containers, names of secrets; of each check id, severity, title and category.
WORKLOADS = ["Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob"]
SECRET_NAME = "(?i)(password|passwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key)"
K8S = {
    "K8S-1": ("K8S-privileged", "P0", "Privileged container: {of}", "Privileged Container"),
    "K8S-2": ("K8S-root", "P1", "Container root çalışabilir: {of}", "Root Container"),
    "K8S-3": ("K8S-image-tag", "P2", "Belirsiz image etiketi (latest/tagsız): {what}", "Image Policy"),
    "K8S-4": ("K8S-plain-secret", "P1", "Manifest'te düz secret env: {what}", "Exposed Secret"),
    "K8S-5": ("K8S-ingress-no-tls", "P2", "Ingress TLS tanımsız (düz HTTP)", "Ingress Misconfig"),
}


def k8s_checks(texts: DataFrame) -> DataFrame:
    """repo_id, path, check, id, severity, title, category of manifests (repo_id, path, doc as JSON text, any number in one).

    Privileged (K8S-1), may run as root (K8S-2), image without a tag or of tag
    latest (K8S-3), a secret in plain environment, one for each (K8S-4), ingress
    without TLS (K8S-5).  Text that is no JSON gives nothing.
    """
    d = documents.manifests(texts.select("repo_id", "path", "doc"))
    v, c = F.col("v"), F.col("c")
    part = lambda p: F.try_variant_get(v, p, "array<variant>")
    boxes = F.coalesce(part("$.spec.containers"), part("$.spec.template.spec.containers"), part("$.spec.jobTemplate.spec.template.spec.containers"))
    pod = F.when(documents.at(v, "$.spec.template.spec").isNotNull(), documents.is_true(v, "$.spec.template.spec.securityContext.runAsNonRoot")).otherwise(documents.is_true(v, "$.spec.securityContext.runAsNonRoot"))
    held = d.where(F.col("kind").isin(WORKLOADS)).select("repo_id", "path", "name", pod.alias("pod"), F.explode(boxes).alias("c"))
    image = F.coalesce(F.try_variant_get(c, "$.image", "string"), F.lit(""))
    env = F.filter(F.coalesce(F.try_variant_get(c, "$.env", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.coalesce(F.try_variant_get(e, "$.name", "string").rlike(SECRET_NAME) & (F.length(documents.text_at(e, "$.value")) > 0), F.lit(False)))
    rooted = F.coalesce(documents.at(c, "$.securityContext.runAsUser") == "0", F.lit(False)) | ~(F.col("pod") | documents.is_true(c, "$.securityContext.runAsNonRoot"))
    hit = lambda ok, n, what: F.when(ok, F.array(F.struct(F.lit(n).alias("check"), what.alias("what")))).otherwise(F.array().cast("array<struct<check:string,what:string>>"))
    found = F.concat(
        hit(documents.is_true(c, "$.securityContext.privileged"), "K8S-1", F.lit("")), hit(rooted, "K8S-2", F.lit("")), hit((image != "") & (~F.contains(image, F.lit(":")) | image.endswith(":latest")), "K8S-3", image),
        F.transform(env, lambda e: F.struct(F.lit("K8S-4").alias("check"), F.try_variant_get(e, "$.name", "string").alias("what"))),
    )
    of = F.concat("name", F.lit("/"), F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("container")))
    out = held.select("repo_id", "path", of.alias("of"), F.explode(found).alias("f")).select("repo_id", "path", "of", "f.check", "f.what")
    tls = documents.at(v, "$.spec.tls")
    bare = d.where(F.col("kind") == "Ingress").where(tls.isNull() | tls.isin("null", "false", '""', "0")).select("repo_id", "path", F.col("name").alias("of"), F.lit("K8S-5").alias("check"), F.lit("").alias("what"))
    table = texts.sparkSession.createDataFrame([(n, *k) for n, k in K8S.items()], "check string, head string, severity string, title string, category string")
    out = out.unionByName(bare).join(F.broadcast(table), "check")  # five rows
    id_ = F.concat("head", F.lit(":"), "of", F.when(F.col("check") == "K8S-4", F.concat(F.lit("/"), "what")).otherwise(""))
    title = F.replace(F.replace("title", F.lit("{of}"), F.col("of")), F.lit("{what}"), F.col("what"))
    return out.select("repo_id", "path", "check", id_.alias("id"), "severity", title.alias("title"), "category")
