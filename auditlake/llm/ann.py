"""Nearest neighbours by collision counting over single projections.

The largest inner product becomes the smallest distance by one more component
that brings every vector to the same length.  A block of vectors is projected on
``PROJECTIONS`` random lines and each projection is kept as a sorted array.  A
query opens a window around its own place on every line, and each vector counts
the lines on which it lies in the window.  Vectors that reach the collision
threshold are verified by their true inner product, those of the most collisions
first.  A vector as near as the query's k-th best so far lies within a line's
window with the probability that a normal variate stays below half width /
distance, and lines are independent: so the least count that such a vector
reaches with probability ``SURE`` is the threshold, which rises as the k-th best
gets better.  Where it would fall below ``SHARE`` of the lines, the windows are
too narrow to tell near from far and widen (virtual rehashing: the same sorted
arrays, only the ends of the windows move), at last to whole lines.  So the
recall that is aimed at holds at any number of rows; how many are verified
follows from the data, up to all of a block.

Places in the sorted arrays are kept as ranks by vector too: a vector is in a
window if its rank is between the window's ends, so that a window of any width is
counted by comparing small integers in order of memory.

Every row is indexed, and a task meets one block of vectors, sent once, with a few
blocks of queries.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, durable, pack, ship, unpack

#: Rows of a block of vectors, of a block of queries; blocks of queries in a task; lines.
BLOCK, QUERIES, TOGETHER, PROJECTIONS = 32768, 512, 4, 64
#: Part of a block in the first windows, least share of the lines as a threshold, probability with which each of the k nearest is verified, and by how much windows widen.
INNER, SHARE, SURE, WIDEN = 0.9, 0.4, 0.99, 1.5
#: Vectors whose ranks are compared at a time.
PIECE = 1024


@lru_cache(maxsize=1 << 14)
def threshold(lines: int, hundredths: int, sure: float) -> int:
    """The most collisions that a vector reaches with probability ``sure``, the half width of windows being so many hundredths of its distance."""
    p, missed = math.erf(hundredths / 100 / math.sqrt(2)), 0.0
    for t in range(lines):
        missed += math.comb(lines, t) * p**t * (1 - p) ** (lines - t)
        if 1 - missed < sure:
            return t
    return lines


def dots(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in order of the components, so that equal rows get equal scores."""
    return np.cumsum(rows.astype(np.float64) * q.astype(np.float64), axis=1)[:, -1]


class Block:
    """Sorted projections of one block of vectors; ``most`` is the largest square of a length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: float, projections: int = PROJECTIONS) -> None:
        self.ids, self.rows, n, dim = ids, rows, len(ids), rows.shape[1]
        #: lengths are at most 1 from here on; vectors whose squares overflow are all verified
        self.scale = math.sqrt(most) if 0 < most < math.inf else 0.0
        if not self.scale:
            return
        lines = np.random.default_rng(dim).normal(size=(dim + 1, projections))
        unit = rows / self.scale
        places = (unit @ lines[:-1] + np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))[:, None] * lines[-1]).T.copy()
        self.lines, self.unit = lines[:-1], unit.astype(np.float32)
        order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, order, 1)
        small = np.uint16 if n < 1 << 16 else np.uint32
        ranks = np.empty((projections, n), small)
        np.put_along_axis(ranks, order, np.arange(n, dtype=small)[None], 1)
        self.ranks = [np.ascontiguousarray(ranks[:, a : a + PIECE]) for a in range(0, n, PIECE)]
        out = int(n * (1 - INNER) / 2)
        self.half = max(1e-9, float(np.median(self.sorted[:, n - 1 - out] - self.sorted[:, out])) / 2)
        #: what float32 may be off by in an inner product of unit vectors
        self.off = (dim + 8) * 2.0**-22
        self.room, self.kept, self.inside = np.empty((n, dim), np.float32), np.empty((projections, PIECE), small), np.empty((projections, PIECE), bool)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows of queries at these places (queries by lines) on every line."""
        return tuple(np.stack([np.searchsorted(s, at[:, j] + d, side) for j, s in enumerate(self.sorted)], 1) for d, side in ((-half, "left"), (half, "right")))

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each vector the lines on which it lies in the window."""
        out, at = np.empty(len(self.ids), np.uint8 if len(low) < 256 else np.uint16), 0
        first, many = (x.astype(self.kept.dtype)[:, None] for x in (low, np.minimum(high - low, np.iinfo(self.kept.dtype).max)))
        for ranks in self.ranks:
            n = ranks.shape[1]
            np.subtract(ranks, first, out=self.kept[:, :n])
            np.less(self.kept[:, :n], many, out=self.inside[:, :n])
            np.add.reduce(self.inside[:, :n].view(np.uint8), axis=0, dtype=out.dtype, out=out[at : at + n])
            at += n
        return out

    def verified(self, counts: np.ndarray, half: float, own: int, asked: np.ndarray, k: int, sure: float, last: bool) -> np.ndarray | None:
        """Places of what may be among the k best by float32; None if windows are too narrow."""
        lines = len(self.sorted)
        reach = np.cumsum(np.bincount(counts, minlength=lines + 1)[::-1])[::-1]
        level, above = int(np.searchsorted(-reach, -min(len(counts), 8 * k), "right")) - 1, lines + 1
        places, scores = np.empty(0, np.int64), np.empty(0, np.float32)
        while True:
            new = np.flatnonzero((counts >= level) & (counts < above))
            got = self.unit.take(new, 0, out=self.room[: len(new)], mode="clip") @ asked
            other = self.ids[new] != own
            places, scores = np.concatenate([places, new[other]]), np.concatenate([scores, got[other]])
            least = 0
            if len(scores) >= k:
                kth = float(np.partition(scores, len(scores) - k)[len(scores) - k])
                near = scores >= kth - 2 * self.off
                places, scores = places[near], scores[near]
                least = threshold(lines, min(800, int(100 * half / math.sqrt(max(1e-12, 2 - 2 * kth)))), sure)
                if least < SHARE * lines and not last:
                    return None
            if level <= least:
                return places
            level, above = max(least, min(level - 1, (level + least) // 2)), level

    def nearest(self, qids: np.ndarray, asked: np.ndarray, k: int, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and scores of each query's k best verified candidates."""
        found: list[np.ndarray | None] = [None] * len(qids)
        if self.scale:
            wide = asked / np.abs(asked).max(1, keepdims=True).astype(np.float64)
            wide /= np.sqrt((wide**2).sum(1, keepdims=True))
            at, single = wide @ self.lines, wide.astype(np.float32)
            left, half = np.arange(len(qids)), self.half
            while len(left):
                low, high = self.windows(at[left], half)
                last = ((high - low) == len(self.ids)).all(1)
                for x, i in enumerate(left.tolist()):
                    found[i] = self.verified(self.collisions(low[x], high[x]), half, int(qids[i]), single[i], k, sure, bool(last[x]))
                left, half = np.array([i for i in left.tolist() if found[i] is None], np.int64), half * WIDEN
        else:
            found = [np.flatnonzero(self.ids != q) for q in qids]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, row, at in zip(qids, asked, found):
            score = dots(self.rows[at], row)
            top = np.lexsort((self.ids[at], -score))[:k]
            out.append((np.full(len(top), q), self.ids[at[top]], score[top]))
        return tuple(np.concatenate(x) for x in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no
    part on either side, nor do rows with a null id; a query meets vectors of
    its own dimension.  The row with the query's id is no candidate, and rows
    that repeat id and vector count once.  Queries without candidates have no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    given = [df.select(F.col(f"`{vector_col}`")).schema[0].dataType.simpleString() for df in (vectors, queries)]
    kind, of = ("float", np.float32) if set(given) == {"array<float>"} else ("double", np.float64)

    def sound(df: DataFrame) -> DataFrame:
        x = columns(df, id_col, vector_col).toDF("id", "v").select(F.col("id").cast("long").alias("id"), F.col("v").cast(f"array<{kind}>").alias("v"))
        x = x.where("id IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(v, c -> c != 0)")
        return x.distinct().withColumn("dim", F.size("v"))

    rows, asked = durable(sound(vectors)), sound(queries)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max(square).alias("most"))

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([pack(t.column("id").to_numpy(), v)], pa.binary())})

    def blocks(df: DataFrame, many: DataFrame, of: str) -> DataFrame:
        x = df.join(F.broadcast(many), "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col(of)).cast("int"))  # a row a dimension
        return x.select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(packed, "dim int, block int, data binary")

    def to(last: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(last) - 1))

    parts = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).withColumn("groups", F.ceil(F.col("parts") / TOGETHER).cast("int"))
    questions = blocks(asked, parts, "parts").join(F.broadcast(sizes), "dim")
    questions = questions.select("dim", to("blocks").alias("at"), F.floor(F.col("block") / TOGETHER).cast("int").alias("group"), "most", "data")
    index = blocks(rows, sizes, "blocks").join(F.broadcast(parts), "dim").select("dim", F.col("block").alias("at"), to("groups").alias("group"), "data")

    def search(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        out, dim = [none], key[0].as_py()
        if mine.num_rows and theirs.num_rows:
            ids, flat = unpack(theirs.column("data")[0].as_py(), np.int64, of)
            block = Block(ids, flat.reshape(-1, dim), mine.column("most")[0].as_py())
            for data in mine.column("data"):
                qids, flat = unpack(data.as_py(), np.int64, of)
                out.append(block.nearest(qids, flat.reshape(-1, dim), k))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(x)) for x in zip(*out)))))

    keys = ("dim", "at", "group")
    found = questions.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
