"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition becomes a run: its texts' digests, sorted, one entry for a
text with the best id and the count.  In every round ``fan_in`` neighbouring
runs meet (three binomial rounds at once for 8), cut into digest ranges so that
no task ever holds a whole run; the shuffle brings the sorted pieces together,
a streaming pass merges equal neighbours and retains the best id.  After about
log(partitions) rounds one run is left, and its answers go back down the same
tree: a parent answers its ``fan_in`` children, a run answers its own rows.
A text that a third of all rows share is one entry of each run, at every level.

Entries are equal only if SHA-256, a second digest and the length all agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, durable, ship, width

_KEY = ["digest", "check", "size"]
_ENTRY = "shard int, run int, digest binary, check long, size long, best long, n long"
_ARROW = pa.schema([("shard", pa.int32()), ("run", pa.int32()), ("digest", pa.binary()), ("check", pa.int64()), ("size", pa.int64()), ("best", pa.int64()), ("n", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            texts = [(x or b"").lower() for x in b.column(1).cast(pa.binary()).to_pylist()]  # bytes.lower() changes A-Z only
            digest = [hashlib.sha256(x).digest() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digest, pa.binary()), pa.array(np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)), pa.array([len(x) for x in texts], pa.int64())],
                ["id", "digest", "check", "size"],
            )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal neighbours of entries sorted by shard, run and key; only the last entry is held from batch to batch."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b.cast(_ARROW)]).combine_chunks().to_batches()[0]
        else:
            b = b.cast(_ARROW)
        if not b.num_rows:
            continue
        numbers = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "run", "check", "size")], 1)
        digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), np.int64).reshape(-1, 4)
        same = (numbers[1:] == numbers[:-1]).all(1) & (digest[1:] == digest[:-1]).all(1)
        start = np.flatnonzero(np.r_[True, ~same])
        out = b.take(pa.array(start))
        best = np.minimum.reduceat(b.column("best").to_numpy(), start)
        n = np.add.reduceat(b.column("n").to_numpy(), start)
        out = pa.RecordBatch.from_arrays([*out.columns[:5], pa.array(best), pa.array(n)], schema=_ARROW)
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty.  ``keep`` says whether the smallest or the largest id of a group
    stays.  A row with a null id counts in group_size and never stays (keep_id
    is null if a group has no other); rows that repeat an id share its fate.  An
    empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark, sign = docs.sparkSession, 1 if keep == "smallest" else -1
    ship(spark)
    none = (1 << 63) - 1
    rows = columns(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    rows = rows.mapInArrow(_digests, "id long, digest binary, check long, size long").withColumn("run", F.spark_partition_id())
    rows = durable(rows.withColumn("shard", F.conv(F.substring(F.hex("digest"), 1, 3), 16, 10).cast("int")))
    entries = rows.select("shard", "run", *_KEY, F.coalesce(F.col("id") * sign, F.lit(none)).alias("best"), F.lit(1).cast("long").alias("n"))
    levels = [durable(entries.sortWithinPartitions("shard", "run", *_KEY).mapInArrow(_merge, _ENTRY))]
    runs = rows.agg(F.max("run")).first()[0] or 0
    while runs > 0:
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        up = up.repartition(width(spark), "shard", "run").sortWithinPartitions("shard", "run", *_KEY)
        levels.append(durable(up.mapInArrow(_merge, _ENTRY)))
        runs //= fan_in
    found = levels.pop()
    while levels:
        child = levels.pop().drop("best", "n").withColumn("up", F.floor(F.col("run") / fan_in).cast("int"))
        found = child.join(found.withColumnRenamed("run", "up"), ["shard", "up", *_KEY]).drop("up")
    out = rows.join(found, ["shard", "run", *_KEY])
    best = F.when(F.col("best") != none, F.col("best") * sign)
    return out.select(F.col("id").alias(id_col), best.alias("keep_id"), F.col("n").alias("group_size"), F.coalesce(F.col("id") == best, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""
