"""What the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CODEC = pa.Codec("zstd", compression_level=1)
#: Bytes of a batch that goes to Python.  Spark's own measure is 10,000 rows, which is 40 MB of texts of 2 KB and their copies on both sides.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, as a real cluster has no copy of the repository; batches for Python are of BATCH_BYTES, if the session sets nothing itself."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_auditlake_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / "auditlake_code.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*")):
            if p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(to))
    context._auditlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where all of Spark is one local process does a temporary one do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp()


def durable(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read on from there: lost executors don't cost the steps before."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As durable, but compressed columns, for what is large; the partitions of what is read again are others."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; unpack needs their types."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(block: bytes, *types: np.dtype | type) -> list[np.ndarray]:
    raw = _CODEC.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, t in zip(sizes.tolist(), map(np.dtype, types)):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * t.itemsize
    return out


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that no other column's name can clash with one that an operator makes."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def free(name: str, df: DataFrame) -> str:
    """The name, or one like it, that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch(data: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(schema, data.values())], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component being the smallest node.

    Alternates the large and the small star until no edge changes.  The smallest
    neighbour is an aggregate with partial sums on the map side and goes back by
    a join whose other side has one row a node, so a hub's edges can be split.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = durable(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
