"""Shards by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded
hash of id and place in the input, so that neither equal ids nor equal texts
gather in one.  Pass two holds a bucket at a time, shuffles it by Fisher and
Yates (Spark's ``shuffle`` with a seed) and writes it.  Buckets in their order,
each in its shuffled order, are a uniformly drawn order of all records; shards
are cut from it by one of three laws:

``rows``   equal numbers of records, at most one apart;
``bytes``  equal sizes, as far as records can be cut (by no more than a record);
``key``    the shard of the largest seeded hash of shard and id: one more shard
           takes records only into itself.

Only the number of records and bytes of each bucket is needed to number them:
at most MAX_BUCKETS rows, counted after the buckets are written, so that a task
that runs twice cannot tell other numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, stored, width

#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
#: Size of a bucket in memory, as long as MAX_BUCKETS of them hold everything (32 TiB); beyond that buckets grow.
BUCKET_BYTES = 32 << 20
MAX_BUCKETS = 1 << 20
LAWS = ("rows", "bytes", "key")
#: Buckets that are numbered together, so that no task sees all buckets at once.
_RUN = 1024


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and RECORD_BYTES."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def home(key: Column, shards: int, seed: int) -> Column:
    """Shard 0 to shards - 1 whose seeded hash with the key is the largest; a null key is one of the keys."""
    drawn = [F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("h"), F.lit(k).alias("k")) for k in range(shards)]
    return (F.greatest(*drawn) if shards > 1 else drawn[0])["k"]


def _scattered(docs: DataFrame, key: Column, size: Column, shard: Column | None, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """record, size, home, bucket, at: records in shuffled buckets, written in the shared folder."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(width(spark), -(-total // bucket_bytes)))
    place = F.monotonically_increasing_id()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), size.alias("size"), (shard if shard is not None else F.lit(0)).alias("home"), F.xxhash64(F.lit(seed), key, place).alias("h"))
    if shard is None:
        bucket = F.pmod("h", F.lit(buckets))
    else:  # buckets of one shard follow each other
        each = -(-buckets // shards)
        bucket, buckets = F.col("home") * each + F.pmod("h", F.lit(each)), each * shards
    rows = rows.withColumn("bucket", bucket.cast("int"))
    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "h")  # a bucket a partition
    held = dealt.groupBy("bucket").agg(F.collect_list(F.struct("record", "size", "home")).alias("held"))
    mixed = held.select("bucket", F.posexplode(F.shuffle("held", seed)).alias("at", "r"))
    return stored(mixed.select("bucket", F.col("at").cast("long").alias("at"), "r.record", "r.size", "r.home"))


def _offsets(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows and bytes before each bucket, of all and of its own home; rows and bytes in all."""
    per = rows.groupBy("home", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("run", F.floor(F.col("bucket") / _RUN))
    runs = per.groupBy("home", "run").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order, own = Window.orderBy("home", "run"), Window.partitionBy("home").orderBy("run")
    runs = runs.select("home", "run", before("n", order).alias("run_n"), before("bytes", order).alias("run_bytes"), before("n", own).alias("run_own"), "n", "bytes")
    w = Window.partitionBy("home", "run").orderBy("bucket")
    out = per.join(runs.drop("n", "bytes"), ["home", "run"]).select(
        "bucket", (F.col("run_n") + before("n", w)).alias("n_before"), (F.col("run_bytes") + before("bytes", w)).alias("bytes_before"), (F.col("run_own") + before("n", w)).alias("own_before")
    )
    n, size = runs.agg(F.sum("n"), F.sum("bytes")).first()
    return out, n or 0, size or 0


def shard(docs: DataFrame, shards: int = 24, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs in shuffled order with the columns size, law, shard, slot and grown_shard behind its own.

    ``slot`` counts from 0 within a shard, without gaps; ``size`` is the UTF-8
    bytes of the text (null: none) and 8.  ``grown_shard`` is the shard if there
    were one more (law ``key``), else null.  Rows that repeat, rows with a null
    id and rows with a null or empty text are records like others: by ``rows``
    and ``bytes`` they are dealt out each by itself, by ``key`` equal ids (null
    is one) share a shard but not a bucket.  With fewer rows than shards some
    shards stay empty; an empty table gives an empty result.  The five new
    names must be free, or ValueError.  The place of a row in the input takes
    part in the draw, so give a table that comes in the same order each time it
    is read (files, or a stored result).  A bucket is held in memory: it is of
    ``bucket_bytes`` on average, and of its longest text at least.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    if shards < 1:
        raise ValueError("shards is 1 at least")
    made = ("size", "law", "shard", "slot", "grown_shard")
    if clash := {c.lower() for c in docs.columns} & set(made):
        raise ValueError(f"docs has a column {sorted(clash)[0]}")
    key, size = F.col(f"`{id_col}`"), size_of(F.col(f"`{text_col}`"))
    rows = _scattered(docs, key, size, home(key, shards, seed) if law == "key" else None, shards, seed, bucket_bytes)
    offsets, n, total = _offsets(rows)
    rows = rows.join(F.broadcast(offsets), "bucket")  # MAX_BUCKETS rows at most
    grown = F.lit(None).cast("int")
    if law == "key":
        number, slot, grown = F.col("home"), F.col("own_before") + F.col("at"), home(F.col(f"record.`{id_col}`"), shards + 1, seed)
    elif law == "rows":
        at = F.col("n_before") + F.col("at")
        number = F.expr(f"(n_before + at) * {shards} div {max(n, 1)}")
        slot = at - F.expr(f"(((n_before + at) * {shards} div {max(n, 1)}) * {n} + {shards - 1}) div {shards}")
    else:
        w = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("bytes_before", F.col("bytes_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
        rows = rows.withColumn("number", F.least(F.lit(shards - 1), F.floor(F.col("bytes_before").cast("decimal(38,0)") * shards / max(total, 1))).cast("int"))
        first = rows.groupBy("number").agg(F.min(F.col("n_before") + F.col("at")).alias("first"))
        rows = rows.join(F.broadcast(first), "number")  # a row a shard
        number, slot = F.col("number"), F.col("n_before") + F.col("at") - F.col("first")
    own = [F.col("record")[c].alias(c) for c in docs.columns]
    return rows.select(*own, F.col("size"), F.lit(law).alias("law"), number.cast("int").alias("shard"), slot.cast("long").alias("slot"), grown.cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=K`` a shard, in whose files the rows follow each other by slot; a lost task writes its files anew."""
    order = free("order__", sharded)
    sharded.withColumn(order, F.floor(F.col("slot") / 65536)).repartition("shard", order).drop(order).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"), 24, "rows")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")
