"""Structured Streaming forms: rules over arriving files, histories, rate limits and dedup over events, findings against a snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.operators import scan
from auditlake.operators.rules import Rule
from auditlake.sources.shared import durable, forget, shared_folder

#: Runs of a batch up to which they are broadcast.
BROADCAST = 500_000


def own_folder(spark: SparkSession) -> str:
    """A new folder for one stream's state and results."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all that is there has been read, as a table in the session's shared folder."""
    spark = stream.sparkSession
    top = own_folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def in_batches(stream: DataFrame, top: str, body: Callable[[DataFrame, int], None]) -> None:
    """Run body(batch, number) over all that is there; a run that broke off goes on at the batch where it did.

    ``body`` must be one that can be run again for the same number without other
    results, as a batch whose commit was lost comes a second time.
    """
    query = stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def scan_arriving(files: DataFrame, rules: list[Rule], top: str) -> None:
    """Findings of a stream of files (repo_id, path, version, content), caps and dedup as in a batch, written below ``top``.

    A batch overwrites its own folder, so that running it again changes nothing.
    What was seen is written too: a new version of a file takes the findings of
    the one before it away, also if it has none itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = batch.select("repo_id", "path", "version")
        known.write.mode("overwrite").parquet(f"{top}/seen/batch={number}")
        w = Window.partitionBy("repo_id", "path").orderBy(F.desc("version"))
        last = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n") if batch.select("repo_id", "path").distinct().count() < known.count() else batch
        found = scan.rule_scan(last.select("repo_id", "path", "content"), rules)
        found.join(known.groupBy("repo_id", "path").agg(F.max("version").alias("version")), ["repo_id", "path"]).write.mode("overwrite").parquet(f"{top}/found/batch={number}")

    in_batches(files, top, write)


def scanned(spark: SparkSession, top: str) -> DataFrame:
    """Findings of the last version of each file that scan_arriving() has seen."""
    last = spark.read.parquet(f"{top}/seen").groupBy("repo_id", "path").agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{top}/found").drop("batch").distinct().join(last, ["repo_id", "path", "version"], "left_semi")


def delta_arriving(runs: DataFrame, top: str) -> None:
    """Changes of a stream of runs (repo_id, run, fingerprint; a null fingerprint says that the run was, whatever it found), written below ``top``.

    A run is compared with the run of its repository before it: in the same
    batch, or else the last one of an earlier batch.  What it has and the other
    lacks is introduced (all of a first run), what both have is persisting, what
    only the other has is fixed.  A run must come whole in one batch, and one
    that is older than the last is left out.  The last run of each repository is
    a table with a version a batch: a batch reads the version before its own and
    writes its own over, so running it again changes nothing; older ones go.
    """
    spark, shape = runs.sparkSession, "repo_id string, run long, fingerprint string"

    def write(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(shape).parquet(f"{top}/last/version={number - 1}") if number else spark.createDataFrame([], shape)
        heads = old.groupBy("repo_id").agg(F.max("run").alias("till"))
        new = batch.select("repo_id", F.col("run").cast("long").alias("run"), "fingerprint")
        # runs of a repository in one batch, not their findings
        came = new.select("repo_id", "run").distinct().join(heads, "repo_id", "left").where("run IS NOT NULL AND (till IS NULL OR run > till)").drop("till")
        named = came.withColumn("old", F.lit(False)).unionByName(heads.join(came.select("repo_id").distinct(), "repo_id", "left_semi").select("repo_id", F.col("till").alias("run"), F.lit(True).alias("old")))
        order = Window.partitionBy("repo_id").orderBy("run")
        chain = durable(named.select("repo_id", "run", "old", F.row_number().over(order).alias("nth"), F.lead("run").over(order).alias("next")))
        few = chain.count() <= BROADCAST
        side = lambda c: F.broadcast(c) if few else c
        rows = new.join(side(chain.where("NOT old")), ["repo_id", "run"]).unionByName(old.join(side(chain.where("old")), ["repo_id", "run"]))
        # one shuffle: the runs that have a finding stand in a row, equal ones beside each other
        own = Window.partitionBy("repo_id", "fingerprint").orderBy("nth")
        near = rows.where("fingerprint IS NOT NULL").withColumns({"before": F.coalesce(F.lag("nth").over(own), F.lit(-1)), "after": F.coalesce(F.lead("nth").over(own), F.lit(-1))})
        told = lambda c, run, change: F.when(c, F.struct(F.col(run).alias("run"), change.alias("change")))
        now = told(~F.col("old") & (F.col("before") != F.col("nth")), "run", F.when(F.col("before") == F.col("nth") - 1, "persisting").otherwise("introduced"))
        gone = told(F.col("next").isNotNull() & ~F.col("after").isin(F.col("nth"), F.col("nth") + 1), "next", F.lit("fixed"))
        near.select("repo_id", "fingerprint", F.explode(F.array_compact(F.array(now, gone))).alias("c")).select("repo_id", "c.run", "fingerprint", "c.change").write.mode("overwrite").parquet(f"{top}/changes/batch={number}")
        kept = old.join(side(chain.where("NOT old").select("repo_id").distinct()), "repo_id", "left_anti").unionByName(rows.where("next IS NULL").select("repo_id", "run", "fingerprint"))
        kept.write.mode("overwrite").parquet(f"{top}/last/version={number}")
        if number > 1:
            forget(spark, f"{top}/last/version={number - 2}")

    in_batches(runs, top, write)


def changes(spark: SparkSession, top: str) -> DataFrame:
    """repo_id, run, fingerprint, change of all runs that delta_arriving() has seen."""
    return spark.read.parquet(f"{top}/changes").drop("batch")


def stream_scan(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of a rule set on a stream of lines: stateless, so every row is judged as it arrives (caps are left to the sink)."""
    return scan.described(scan.matches(lines, rules), rules).select("repo_id", "path", "line_no", "rule_id", "severity")


def stream_history(events: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Counts by kind in tumbling windows of event time, given out once the watermark has passed."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream_dedup(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row a key within the watermark's span."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_rate_limit(log: DataFrame, seconds: int = 600, least: int = 5, late: str = "1 day") -> DataFrame:
    """window_start, url, served of bursts against one URL with ``least`` answers of status 200 to 499 and no 429, given out once the watermark has passed."""
    seen = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    burst = seen.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "url").agg(F.count_if(F.col("status").between(200, 499)).alias("served"), F.bool_or(F.col("status") == 429).alias("held"))
    return burst.where(f"served >= {least} AND NOT held").select(F.col("w.start").alias("window_start"), "url", "served")


def stream_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Arriving findings with change (introduced, persisting) against a snapshot, joined by repository and fingerprint."""
    by = ["repo_id", "fingerprint"]
    return now.join(before.select(*by).distinct().withColumn("old", F.lit(True)), by, "left").withColumn("change", F.when(F.col("old"), "persisting").otherwise("introduced")).drop("old")
