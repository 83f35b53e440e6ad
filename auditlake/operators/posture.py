"""Posture of a repository: layers with their weights, status by scoreboard, ranks, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import round1
from auditlake.operators.rollup import overall_score, posture_status, summary

# Weight of each layer, and the least score of each rank.
WEIGHTS = {"A": 10, "B": 18, "D": 10, "PAY": 12, "ACCESS": 14, "AUTH": 11, "API": 9, "PRIV": 10, "WEB": 9, "FLOW": 11, "EMAIL": 7, "UPLOAD": 12, "CLOUD": 12, "K8S": 8, "FE": 7, "AI": 7, "C": 10}
LADDER = {1: 0, 2: 21, 3: 41, 4: 61, 5: 81, 6: 96}


def weight_of(layer: Column) -> Column:
    """A layer's weight, 0 for what is no layer."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[layer], F.lit(0))


def posture_bridge(board: DataFrame) -> DataFrame:
    """repo_id, layer, weight, status, verified, findings: every layer of every repository of a scoreboard.

    A layer without a row of the scoreboard, or without a score, is optional; a
    row gives its number of findings, null without one.
    """
    known = posture_status(board).join(board.select("repo_id", "module", "findings"), ["repo_id", "module"]).withColumnRenamed("module", "layer")
    grid = board.select("repo_id").distinct().select("repo_id", F.explode(F.lit(list(WEIGHTS))).alias("layer"))
    status = F.coalesce("status", F.lit("optional"))
    return grid.join(known, ["repo_id", "layer"], "left").select("repo_id", "layer", weight_of(F.col("layer")).alias("weight"), status.alias("status"), (status == "active").alias("verified"), "findings")


def equipped_count(layers: DataFrame) -> DataFrame:
    """repo_id, equipped, layers: active ones of those that weigh something."""
    return layers.where("weight > 0").groupBy("repo_id").agg(F.count_if(F.col("status") == "active").alias("equipped"), F.count("*").alias("layers"))


def ranks(scores: DataFrame, score_col: str = "posture") -> DataFrame:
    """scores with level (the lowest for a null score), next_level and missing, the points to it; null on the last one."""
    s, level, ahead, least = F.col(score_col), F.lit(min(LADDER)), F.lit(None).cast("int"), F.lit(None).cast("int")
    for n, low in LADDER.items():
        level = F.when(s >= low, n).otherwise(level)
    for n, low in reversed(LADDER.items()):
        ahead, least = F.when(s < low, n).otherwise(ahead), F.when(s < low, low).otherwise(least)
    return scores.select("*", level.alias("level"), ahead.alias("next_level"), (least - s).alias("missing"))


def posture_metrics(summary: DataFrame, layers: DataFrame) -> DataFrame:
    """repo_id, total, p0, p1, max_cvss, threat, breakdown: a summary with the findings of each layer as a map."""
    threat = F.when(F.col("p0") > 0, F.concat(F.col("p0").cast("string"), F.lit(" P0"))).otherwise("none")
    each = layers.where("findings IS NOT NULL").groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "findings")))).alias("breakdown"))  # as many entries as layers
    return summary.join(each, "repo_id", "left").select("repo_id", "total", "p0", "p1", "max_cvss", threat.alias("threat"), "breakdown")


def overall_parity(layers: DataFrame) -> DataFrame:
    """repo_id, overall: the mean of parity layers that have a score, to one decimal; null without any."""
    return layers.groupBy("repo_id").agg(round1(F.sum(F.round(F.col("score") * 10).cast("long")) / F.count("score") / 10).alias("overall"))


def parity_layer_findings(layers: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, layer and the findings' other columns: findings whose id a layer lists (repo_id, layer, finding_ids)."""
    listed = layers.select("repo_id", "layer", F.explode(F.array_distinct("finding_ids")).alias("id"))
    return listed.join(findings, ["repo_id", "id"])


def summary_scores(findings: DataFrame, board: DataFrame, layers: DataFrame) -> DataFrame:
    """summary() with overall_score of a scoreboard and parity_score of parity layers, null where a repository has none; repositories of any of the three."""
    parity = overall_parity(layers).withColumnRenamed("overall", "parity_score")
    out = summary(findings).join(overall_score(board), "repo_id", "full").join(parity, "repo_id", "full")
    return out.fillna(0, ["total", "p0", "p1", "p2", "p3", "max_cvss"])
