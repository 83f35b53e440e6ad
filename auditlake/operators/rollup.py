"""Roll-ups of findings: scoreboard, scores, counts, gate, checklists, posture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import round1
from auditlake.operators.rules import MODULES

# What a finding costs its module, weights of posture layers, and the ladder of ranks.
PENALTY = {"P0": 5.0, "P1": 2.5, "P2": 1.0, "P3": 0.25}
FACTORS = {"verified": 1.0, "claimed": 0.6, "failed": 0.0, "partial": 0.6, "open": 0.0, "optional": 0.0, "active": 1.0}


def penalty(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, cost in PENALTY.items():
        out = F.when(severity == name, cost).otherwise(out)
    return out


def scoreboard(findings: DataFrame, ran: list[str] | None = None) -> DataFrame:
    """repo_id, module, score, findings, p0, p1 for every repository and module.

    10 less the penalties, 0 at least, to one decimal; null for a module that
    neither ran (``ran`` names those that did) nor has findings.
    """
    spark = findings.sparkSession
    dims = spark.createDataFrame([(m, ran is not None and m in ran) for m in MODULES], "module string, ran boolean")
    grid = findings.select("repo_id").distinct().select("repo_id", F.explode(F.lit(MODULES)).alias("module")).join(F.broadcast(dims), "module")
    sums = findings.groupBy("repo_id", "module").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "P0").alias("p0"), F.count_if(F.col("severity") == "P1").alias("p1"), F.sum(penalty(F.col("severity"))).alias("cost"))
    out = grid.join(sums, ["repo_id", "module"], "left")
    score = F.when(F.col("ran") | F.col("n").isNotNull(), round1(F.greatest(F.lit(0.0), 10 - F.coalesce("cost", F.lit(0.0)))))
    return out.select("repo_id", "module", score.alias("score"), *(F.coalesce(c, F.lit(0)).alias(a) for c, a in (("n", "findings"), ("p0", "p0"), ("p1", "p1"))))


def overall_score(board: DataFrame) -> DataFrame:
    """repo_id, overall_score: the mean of the modules that have a score, to one decimal."""
    tenths = F.round(F.col("score") * 10).cast("long")  # whole numbers, so that no order of adding matters
    return board.groupBy("repo_id").agg((F.floor(F.sum(tenths) / F.count("score") + 0.5) / 10).alias("overall_score"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in PENALTY))


def fail_gate(findings: DataFrame, threshold: int) -> DataFrame:
    """repo_id, failed: whether any finding is of the threshold's rank (0 for P0) or graver."""
    return findings.groupBy("repo_id").agg(F.bool_or(F.substring("severity", 2, 1).cast("int") <= threshold).alias("failed"))


def posture_status(board: DataFrame) -> DataFrame:
    """scoreboard with status: optional without a score, open with P0, partial with P1 or below 8, else active."""
    status = F.when(F.col("score").isNull(), "optional").when(F.col("p0") > 0, "open").when((F.col("p1") > 0) | (F.col("score") < 8), "partial").otherwise("active")
    return board.select("repo_id", "module", status.alias("status"))


def measured_posture_score(posture: DataFrame, weight: Column) -> DataFrame:
    """repo_id, posture: weighted share of what layers reach, in percent; optional layers count in the whole."""
    factor = F.lit(0.0)
    for name, f in FACTORS.items():
        factor = F.when(F.col("status") == name, f).otherwise(factor)
    return posture.groupBy("repo_id").agg(F.floor(F.sum(weight * factor) / F.sum(weight) * 100 + 0.5).cast("long").alias("posture"))


def delta_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo_id", "change", "severity").agg(F.count("*").alias("n"))


def delta_of_runs(runs: DataFrame, changes: DataFrame, before: str, now: str) -> DataFrame:
    """repo_id, and of two runs of a history (repo_id, run, overall_score, parity_score): scores before and after, how they moved, and counts of changes.

    ``moved`` is the signed change to one decimal, null where a score is
    missing; ``trend`` is up, down, same or unknown.  A repository without a run
    before is a first run, whose findings are all new.
    """
    side = lambda run, tag: runs.where(F.col("run") == run).select("repo_id", F.col("overall_score").alias(f"overall_{tag}"), F.col("parity_score").alias(f"parity_{tag}"))
    moved = changes.groupBy("repo_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("fixed", "introduced", "persisting")), *(F.count_if((F.col("change") == "persisting") & (F.col("severity") == s)).alias(f"still_{s.lower()}") for s in PENALTY))
    out = side(now, "after").join(side(before, "before").withColumn("known", F.lit(True)), "repo_id", "left").join(moved, "repo_id", "left")
    counts = ["fixed", "introduced", "persisting", *(f"still_{s.lower()}" for s in PENALTY)]
    change = lambda k: F.round(F.col(f"{k}_after") - F.col(f"{k}_before"), 1)
    trend = lambda k: F.when(change(k).isNull(), "unknown").when(change(k) > 0, "up").when(change(k) < 0, "down").otherwise("same")
    scores = [c for k in ("overall", "parity") for c in (F.col(f"{k}_before"), F.col(f"{k}_after"), change(k).alias(f"{k}_moved"), trend(k).alias(f"{k}_trend"))]
    return out.fillna(0, counts).select("repo_id", F.col("known").isNull().alias("is_first"), *scores, *counts)


def checklists_all(parts: list[DataFrame]) -> DataFrame:
    """repo_id, checklist, control, status of all lists, and of each list the score of those of its controls that are known."""
    rows = reduce(lambda a, b: a.unionByName(b), (p.select("repo_id", "checklist", "control", "status") for p in parts))
    return rows.join(checklist_score(rows, ["repo_id", "checklist"]), ["repo_id", "checklist"])


def summary(findings: DataFrame) -> DataFrame:
    """repo_id, total, p0..p3, max_cvss (0 without any)."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in PENALTY]
    return findings.groupBy("repo_id").agg(F.count("*").alias("total"), *counts, F.max(F.coalesce("cvss", F.lit(0.0))).alias("max_cvss"))


# Controls of the application standard that are followed.
ASVS = ["2.1", "3.3", "3.4", "4.2", "5.3", "6.2", "6.3", "6.4"]


def asvs_checklist(referenced: DataFrame, controls: list[str] = ASVS) -> DataFrame:
    """repo_id, control, status for findings (repo_id, reference): fail if a code is the control or below it, else unknown."""
    codes = referenced.select("repo_id", F.regexp_extract("reference", r"(?i)ASVS\s*(\d+(?:\.\d+)*)", 1).alias("code")).where("code != ''").distinct()
    hit = codes.select("repo_id", F.explode(F.filter(F.lit(controls), lambda c: (F.col("code") == c) | F.startswith(F.col("code"), F.concat(c, F.lit("."))))).alias("control")).distinct()
    grid = referenced.select("repo_id").distinct().select("repo_id", F.explode(F.lit(controls)).alias("control"))
    return grid.join(hit.withColumn("bad", F.lit(True)), ["repo_id", "control"], "left").select("repo_id", "control", F.when(F.col("bad"), "fail").otherwise("unknown").alias("status"))


def checklist_score(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """repo_id (or ``by``), score: pass and half of partial over what was assessed, in percent; null if nothing was."""
    done = F.count_if(F.col("status") != "unknown")
    got = F.count_if(F.col("status") == "pass") + 0.5 * F.count_if(F.col("status") == "partial")
    return items.groupBy(*(by or ["repo_id"])).agg(F.when(done > 0, F.floor(got / done * 100 + 0.5).cast("long")).alias("score"))
