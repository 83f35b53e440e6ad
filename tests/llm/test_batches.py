"""Texts go to Python in batches of few bytes, not of many rows."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from auditlake.llm import common


def test_batches_are_cut_by_bytes(spark):
    common.ship(spark)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), F.lit(4000)).alias("text"))
    got = [x["n"] for x in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 24_000_000 and max(got) <= common.BATCH_BYTES + 100_000
