"""Jaccard join on word n-gram sets by a blocked sparse matrix product.

The incidence matrix has a row for each distinct set (documents with equal sets
share one) and a column for each n-gram.  Its product with its own transpose
counts overlaps; for a Jaccard bound t, sizes bound which entries can matter:

* a pair needs an overlap of ``need(x, y) = ceil(t / (1 + t) * (x + y))``, so the
  sizes must be within t of each other, and with columns in one global order two
  rows must meet in the first ``n - ceil(t n) + 1`` columns of each; only these
  entries are multiplied;
* of the row whose prefix ends first, a pair can only share columns of the prefix
  that other prefixes have too, and what lies behind it.  Pairs for which that is
  below ``need`` are discarded when they meet;
* overlaps are accumulated over the blocks of columns, and a pair whose count and
  what lies behind the prefix that ends first stay below ``need`` is discarded.

Columns are ordered by a frequency sketch of fixed size that counts every n-gram
of every document, frequent ones last, so that common passages are multiplied
only where a row has little else.  Blocks are hash ranges of columns, and their
number follows from the bytes of the text.

Links are wanted up to connectivity.  The first products count the overlap of
each row with the most central rows of its columns and take one link a row;
components follow.  The last one takes the columns whose rows are still in
several components, and multiplies rows of different components, one link a row
and component: every link between texts is then inside a component, and a group
of near copies costs its number, not their square.  The columns behind the
prefixes of the pairs that are left are counted from the texts of these rows
alone, which are fetched by id and hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, components, pack, ship, stored, unpack, width
from .words import U, Words, mix, pieces

#: Cells of the frequency sketch (a power of two) and of one piece of it.
CELLS, PIECE = 1 << 22, 1 << 16
#: Rows of three longs up to which a side is broadcast; above, both sides are shuffled.
BROADCAST = 500_000
#: Rounds of links to the centre of each column before all that is left is counted.
ROUNDS = 2
#: Most central rows that a row is held against in a round.
TRIES = 3
#: Texts a block of rows, and rows that ask a block in one task.
ROWS, ASKERS = 8000, 8000
#: Bytes of text to a block of columns, entries (and a 64th of the meetings) to one of those still open, rows of a column of which each meets each in one task,
#: and rows of a column that choose one centre.
SLOT_BYTES, OPEN, CHUNK = 32 << 20, 200_000, 1024
STAR = 1 << 16
#: Pairs of rows that a task looks at, and meetings that it holds, at once.
FOLD = 1 << 20
_LAST = (1 << 63) - 1


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes, lower-cased A-Z; the whole sequence as one if shorter; empty without words."""
    for a, b, w in pieces(texts, lower=True):
        g, _ = w.grams(n)
        for i in range(b - a):
            lo, hi = w.first[i], w.first[i + 1]
            if hi - lo >= n:
                yield np.unique(g[lo : hi - n + 1])
            elif hi > lo:
                yield short_key(w, lo, hi)
            else:
                yield np.zeros(0, U)


def short_key(w: Words, lo: int, hi: int) -> np.ndarray:
    """One hash of a whole short sequence; its length keeps it apart from n-grams."""
    h = np.array([hi - lo], U)
    for x in w.hash[lo:hi]:
        h = mix(h * U(0x9FB21C651E98DF25) + x)
    return h


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=U) + U(len(s)), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def need(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of x and y that reaches the bound."""
    return -(-percent * (x + y) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def class_of(a: int, b: int, shared: np.ndarray) -> int:
    """The number of a set: its first key, or the second where different sets have the same first one."""
    at = int(np.searchsorted(shared, a)) if len(shared) else 0
    return b if at < len(shared) and shared[at] == a else a


def _first_pass(rows: DataFrame, n: int) -> DataFrame:
    """One scan: a member row (id, check, class, twin, size) a document, and each task's frequency sketch, a row a PIECE of cells."""
    names = ["id", "check", "class", "twin", "size", "piece", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        some = False
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                key, size = [], []
                for s in shingle_sets(b.column(2), n):
                    some = some or len(s) > 0
                    cell, k = np.unique((s >> U(64 - 22)).astype(np.int64), return_counts=True)
                    cells[cell] += k.astype(np.uint32)
                    key.append(set_key(s))
                    size.append(len(s))
                keys, m = np.array(key, np.int64).reshape(-1, 2), b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(size, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        for k in range(CELLS // PIECE if some else 0):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.array([k], pa.int32()), pa.array([pack(cells[k * PIECE : (k + 1) * PIECE])], pa.binary())], names)

    return rows.mapInArrow(run, "id long, check long, class long, twin long, size long, piece int, cells binary")


def _added(parts: DataFrame) -> DataFrame:
    """The sketch of all tasks, a byte a cell on a scale of logarithms."""

    def add(key: tuple, blocks: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, np.uint64)
        for x in blocks.column("cells"):
            total += unpack(x.as_py(), np.uint32)[0]
        scale = np.minimum(255, np.floor(4 * np.log2(total + 1.0))).astype(np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([pack(scale)], pa.binary())})

    return parts.groupBy("piece").applyInArrow(add, "piece int, cells binary")


def _ordered(s: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A set's columns, rare first."""
    return s[np.lexsort((s, scale[(s >> U(64 - 22)).astype(np.int64)]))]


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, groups: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id for every row; with ``groups`` also check (xxhash64 of the text) and group (a number of the component).

    Two rows link when 100 * overlap >= percent * union of their sets; an empty
    set (null or empty text, or no word) links with nothing, so such a row is its
    own component.  component_id is the smallest id that links reach.  Rows that
    repeat an id count as one document each and link by their own texts, and so
    do rows with a null id, whose component_id is null if no id is reached.
    Whole texts of any length; an empty table gives an empty result.  Other
    columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = columns(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("check"), "text")
    first = stored(_first_pass(rows, n))
    members = first.where("piece IS NULL").select("id", "check", "class", "twin", "size")
    scale = np.zeros(CELLS, np.uint8)
    for x in _added(first.where("piece IS NOT NULL").select("piece", "cells")).collect():  # CELLS bytes before compression, whatever the input
        scale[x["piece"] * PIECE : (x["piece"] + 1) * PIECE] = unpack(x["cells"], np.uint8)[0]
    # different sets with one 64-bit key: N * N / 2 ** 65 of N sets, none of a billion and hundreds of 10 ** 11
    twins = members.groupBy("class").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low < high").select("class").collect()
    shared = np.sort(np.array([x["class"] for x in twins], np.int64))
    if len(shared):
        members = members.withColumn("class", F.when(F.col("class").isin(shared.tolist()), F.col("twin")).otherwise(F.col("class")))
    entries = _entries(rows, n, percent, scale, shared)

    # one text of each class, whose row of the matrix is read again where a pair has to be counted
    found = F.min(F.struct(F.coalesce("id", F.lit(_LAST)).alias("k"), "check"))
    texts = members.where("size > 0").groupBy("class").agg(found.alias("t")).select("class", "t.k", "t.check")
    told_by, links, tried = entries.withColumn("component", F.col("class")).withColumn("weight", F.lit(0).cast("long")), None, None
    for _ in range(ROUNDS):
        pairs = _stars(told_by, percent)
        pairs = stored(_few(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti")))
        asked = pairs.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("n", "y", "c")), asc=False).alias("a")).select("x", F.col("a.y").alias("ys"), F.col("a.c").alias("cs"))
        new = stored(_verified(asked, rows, texts, n, percent, True))
        tried = pairs.select("x", "y") if tried is None else tried.unionByName(pairs.select("x", "y"))
        links = new if links is None else links.unionByName(new)
        if new.isEmpty():
            break
        told_by = _told(entries, components(links))
    last = stored(_verified(_across(told_by, percent), rows, texts, n, percent, False))
    named = members.join(components(links.unionByName(last)).withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.where("size > 0").groupBy(F.col("component").alias("of")).agg(F.min("id").alias("low"))
    out = named.join(least, (F.col("component") == F.col("of")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"), *([F.col("check"), F.col("component").alias("group")] if groups else []))


def _entries(rows: DataFrame, n: int, percent: int, scale: np.ndarray, shared: np.ndarray) -> DataFrame:
    """Entries of the prefixes in columns that rows of like size have, too: col, class, size, last, tight, central, many.

    ``last`` is the place of the prefix's end in the order, ``tight`` how many
    columns lie behind it and how many of its own are shared, ``many`` how many
    rows the column has.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(width(spark), -(-size // SLOT_BYTES))
    told = spark.sparkContext.broadcast((scale, shared))

    def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = told.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                cols, cls, num, last, seen = [], [], [], [], set()
                for s in shingle_sets(whole.slice(at, 2048).column(0), n):
                    k = class_of(*set_key(s), known)
                    if len(s) and k not in seen:
                        seen.add(k)
                        p = _ordered(s, order)[: prefix(len(s), percent)]
                        cols.append(p)
                        cls.append(np.full(len(p), k, np.int64))
                        num.append(np.full(len(p), len(s), np.int32))
                        last.append(np.full(len(p), (int(order[int(p[-1] >> U(64 - 22))]) << 55) | int(p[-1] >> U(9)), np.int64))
                if cols:
                    c, k, z, e = map(np.concatenate, (cols, cls, num, last))
                    slot = (mix(c) % U(slots)).astype(np.int32)
                    o = np.argsort(slot, kind="stable")
                    cut = np.flatnonzero(np.r_[True, np.diff(slot[o]) > 0, True])
                    yield pa.RecordBatch.from_arrays([pa.array(slot[o][cut[:-1]]), pa.array([pack(c[i], k[i], z[i], e[i]) for i in np.split(o, cut[1:-1])], pa.binary())], ["slot", "block"])

    def meet(t: pa.Table) -> pa.Table:
        """Entries of one block's columns that have a row of another set whose size is within the bound."""
        c, k, z, e = (np.concatenate(x) for x in zip(*(unpack(x.as_py(), U, np.int64, np.int32, np.int64) for x in t.column("block"))))
        o = np.lexsort((k, z, c))
        c, k, z, e = c[o], k[o], z[o].astype(np.int64), e[o]
        new = np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])]  # a class comes once from each batch
        c, k, z, e = c[new], k[new], z[new], e[new]
        ends = np.flatnonzero(np.r_[c[1:] != c[:-1], True])
        times = np.diff(np.r_[-1, ends])
        many = np.repeat(times, times)
        # by size, the neighbours in the column are the nearest
        near = (c[1:] == c[:-1]) & (100 * z[:-1] >= percent * z[1:])
        keep = np.r_[False, near] | np.r_[near, False]
        return pa.table({"col": c[keep].view(np.int64), "class": k[keep], "size": z[keep], "last": e[keep], "many": many[keep]})

    both = rows.select("text").mapInArrow(rows_in, "slot int, block binary").groupBy("slot").applyInArrow(meet, "col long, class long, size long, last long, many long")
    own = Window.partitionBy("class")
    # a row is central if its columns are common to many rows: the original of a group of near copies is
    return stored(both.select("col", "class", "size", "last", (F.expr(_behind(percent)) + F.count("*").over(own)).alias("tight"), F.avg("many").over(own).alias("central"), "many"))


def _behind(percent: int) -> str:
    """Columns behind the prefix of a row."""
    return f"CAST(ceil({percent} * size / 100D - 1e-9D) AS BIGINT) - 1"


def _told(entries: DataFrame, found: DataFrame) -> DataFrame:
    """entries with the component of their class and its weight, the number of its other classes."""
    found = found.withColumnRenamed("node", "class")
    weights = found.groupBy("component").agg(F.count("*").alias("weight"))
    whole = found.unionByName(weights.select(F.col("component").alias("class"), "component"))  # the class that gives the name is in it, too
    found = stored(whole.join(weights, "component"))
    side = F.broadcast(found) if found.count() <= BROADCAST else found
    return entries.drop("component", "weight").join(side, "class", "left").withColumn("component", F.coalesce("component", "class")).withColumn("weight", F.coalesce("weight", F.lit(0)))


def _stars(entries: DataFrame, percent: int) -> DataFrame:
    """x, y, c, n: in how many columns x is its component's most central row and y, of component c, that of the column's largest component.

    Columns of more than STAR rows choose a centre for each part of their rows.
    """
    blocks = max(1, -(-entries.count() // OPEN))
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("many") / STAR)).cast("int")
    dealt = entries.withColumn("part", part).select(F.pmod(F.xxhash64("col", "part"), F.lit(blocks)).cast("int").alias("slot"), "part", "col", "class", "size", "last", "tight", "central", "component")

    def meet(t: pa.Table) -> pa.Table:
        part, col, cls, size, last, tight, central, comp = (t.column(c).to_numpy() for c in t.column_names[1:])
        o = np.lexsort((cls, central, comp, part, col))
        part, col, cls, size, last, tight, comp = (v[o] for v in (part, col, cls, size, last, tight, comp))
        own = np.r_[(np.diff(col) != 0) | (np.diff(part) != 0), True]
        best = np.flatnonzero(own | np.r_[np.diff(comp) != 0, True])  # the last row of a component is its most central
        n = np.diff(np.r_[-1, best])
        group = np.cumsum(np.r_[0, own[best][:-1]])
        order = np.lexsort((n, group))
        main = best[order[np.flatnonzero(np.r_[np.diff(group[order]) != 0, True])]][group]
        x, y = best, main
        can = np.minimum(np.minimum(size[x], size[y]), np.minimum(np.where(last[x] <= last[y], tight[x], size[x]), np.where(last[y] <= last[x], tight[y], size[y])))
        keep = (cls[x] != cls[y]) & (can >= need(size[x], size[y], percent))
        pairs, times = np.unique(np.stack([cls[x[keep]], cls[y[keep]], comp[y[keep]]], 1), axis=0, return_counts=True)
        return pa.table({"x": pa.array(pairs[:, 0]), "y": pa.array(pairs[:, 1]), "c": pa.array(pairs[:, 2]), "n": pa.array(times.astype(np.int64))})

    met = dealt.groupBy("slot").applyInArrow(meet, "x long, y long, c long, n long")
    return met.groupBy("x", "y", "c").agg(F.sum("n").alias("n"))


def _few(pairs: DataFrame) -> DataFrame:
    """The TRIES partners of each row with which it shares most; the others are left to later products."""
    w = Window.partitionBy("x").orderBy(F.desc("n"), "y")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= TRIES).drop("r")


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """x, ys, cs: pairs that can still reach the bound, of different components (cs: that of y), those that share most first.

    Of two rows that of the lighter component asks, in whatever column they meet,
    and rows of a column's heaviest component don't meet each other.  A column of
    many rows is cut into squares of CHUNK rows a side.  What a row meets in a
    block of columns is one packed row; those are added up by row.
    """
    parts = entries.groupBy("col", "weight", "component").agg(F.count("*").alias("n")).groupBy("col").agg(F.max(F.struct("weight", "component", "n")).alias("m"), F.count("*").alias("parts"), F.sum("n").alias("rows"))
    parts = parts.where("parts > 1").select("col", F.col("m.component").alias("main"), F.ceil(F.col("rows") / CHUNK).cast("int").alias("own"), F.ceil((F.col("rows") - F.col("m.n")) / CHUNK).cast("int").alias("few"), "rows", F.col("m.n").alias("n"))
    parts = stored(parts.withColumn("work", F.col("rows") + F.col("rows") * (F.col("rows") - F.col("n")) / 64))
    work = parts.agg(F.sum("work")).first()[0] or 0
    open_ = entries.join(parts.drop("rows", "n", "work"), "col").select("col", "class", "size", "last", "tight", "weight", "component", "main", "own", "few")
    blocks = max(1, math.ceil(work / OPEN))
    # a row is once among the few (if not of the heaviest component) for each chunk of all, and once among all for each chunk of the few
    asks = open_.where("component != main").withColumn("ask", F.lit(True)).withColumn("i", F.expr("CAST(pmod(xxhash64(class), few) AS INT)")).withColumn("j", F.explode(F.expr("sequence(0, own - 1)")))
    all_ = open_.withColumn("ask", F.lit(False)).withColumn("i", F.explode(F.expr("sequence(0, few - 1)"))).withColumn("j", F.expr("CAST(pmod(xxhash64(class), own) AS INT)"))
    dealt = asks.unionByName(all_).withColumn("slot", F.pmod(F.xxhash64("col", "i", "j"), F.lit(blocks)).cast("int")).select("slot", "ask", "col", "i", "j", "class", "size", "last", "tight", "weight", "component")

    behind = lambda z: -(-percent * z // 100) - 1

    def meet(t: pa.Table) -> pa.Table:
        ask, col, i, j, cls, size, last, tight, weight, comp = (t.column(c).to_numpy() for c in t.column_names[1:])
        order = np.lexsort((ask, j, i, col))
        begin = np.flatnonzero(np.r_[True, (np.diff(col[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)][: len(order)])
        held, met, waiting = np.zeros((0, 5), np.int64), [], 0

        def folded() -> np.ndarray:
            """Pairs once, with the number of their meetings."""
            pairs = np.concatenate([held, *met])
            o = np.lexsort((pairs[:, 1], pairs[:, 0]))
            first = np.flatnonzero(np.r_[True, (np.diff(pairs[o, 0]) != 0) | (np.diff(pairs[o, 1]) != 0)][: len(o)])
            out = pairs[o[first]]
            out[:, 4] = np.add.reduceat(pairs[o, 4], first) if len(first) else 0
            met.clear()
            return out

        # in each square the rows that don't ask come first; all its pairs are numbered, and squares are taken together up to FOLD pairs
        ends = np.r_[begin[1:], len(order)]
        asking = np.add.reduceat(ask[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        rest = ends - begin - asking
        total = np.r_[0, np.cumsum(asking * rest)]
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(total, total[at] + FOLD, "right")) - 1)
            square = np.repeat(np.arange(at, to), (asking * rest)[at:to])
            number = np.arange(total[at], total[to]) - total[square]
            x = order[begin[square] + rest[square] + number // np.maximum(1, rest[square])]
            y = order[begin[square] + number % np.maximum(1, rest[square])]
            fits = (weight[x] < weight[y]) | ((weight[x] == weight[y]) & (comp[x] < comp[y]))
            can = np.minimum(np.minimum(size[x], size[y]), np.minimum(np.where(last[x] <= last[y], tight[x], size[x]), np.where(last[y] <= last[x], tight[y], size[y])))
            keep = fits & (can >= need(size[x], size[y], percent))
            x, y = x[keep], y[keep]
            most = np.where(last[x] <= last[y], behind(size[x]), behind(size[y])) - need(size[x], size[y], percent)  # the count that it lacks, below 0
            met.append(np.stack([cls[x], cls[y], comp[y], most, np.ones(len(x), np.int64)], 1))
            waiting, at = waiting + len(x), to
            if waiting > FOLD:
                held, waiting = folded(), 0
        pairs = folded()
        cut = np.flatnonzero(np.r_[True, np.diff(pairs[:, 0]) != 0, True]) if len(pairs) else np.zeros(1, int)
        packed = [pack(*pairs[a:b, 1:].T) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"x": pa.array(pairs[cut[:-1], 0], pa.int64()), "ys": pa.array(packed, pa.binary())})

    def add(key: tuple, t: pa.Table) -> pa.Table:
        y, c, most, n = (np.concatenate(g) for g in zip(*(unpack(v.as_py(), *[np.int64] * 4) for v in t.column("ys"))))
        y, first, at = np.unique(y, return_index=True, return_inverse=True)
        n, c, most = np.bincount(at, n, len(y)).astype(np.int64), c[first], most[first]
        # counts of a row whose prefix ends first are whole: what it lacks must lie behind
        keep = np.flatnonzero(n + most >= 0)
        keep = keep[np.argsort(-n[keep], kind="stable")]
        lists = lambda v: pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), pa.array(v[keep], pa.int64()))
        return pa.table({"x": pa.array([key[0].as_py()], pa.int64()), "ys": lists(y), "cs": lists(c)})

    met = dealt.groupBy("slot").applyInArrow(meet, "x long, ys binary").groupBy("x").applyInArrow(add, "x long, ys array<long>, cs array<long>")
    return stored(met.where("size(ys) > 0"))


def _verified(asked: DataFrame, rows: DataFrame, texts: DataFrame, n: int, percent: int, one: bool) -> DataFrame:
    """Links (a, b) that asked (x, ys, cs) rows have, the first of each x, or the first of each x and component (cs).

    A row's text goes once to each block of texts that it asks, and a block's
    texts to as many parts as its askers fill, so that neither side grows in a task.
    """

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays([b.column(0), pc.list_flatten(b.column(1))]))], ["class"])

    few = stored(asked.select("x", "ys").mapInArrow(classes, "class long").distinct().join(texts, "class"))
    number = few.count()
    side = F.broadcast(few) if number <= BROADCAST else few  # the whole texts need not be shuffled for few classes
    key = rows.withColumn("k", F.coalesce("id", F.lit(_LAST))).join(side, ["k", "check"])
    text = stored(key.groupBy("class").agg(F.first("text").alias("text")))
    blocks = max(1, -(-number // ROWS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for x, ys, cs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                y, c = ys.values.to_numpy(), cs.values.to_numpy()
                block = y % blocks  # classes are hashes
                out += [(x, int(k), y[block == k], c[block == k]) for k in np.unique(block)]
            x, k, y, c = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(k, pa.int32()), pa.array(y, pa.list_(pa.int64())), pa.array(c, pa.list_(pa.int64()))], ["x", "block", "ys", "cs"])

    asked = asked.select("x", "ys", "cs").mapInArrow(split, "x long, block int, ys array<long>, cs array<long>")
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("parts"))
    left = asked.join(text.select(F.col("class").alias("x"), F.col("text").alias("x_text")), "x").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    left = left.select("block", "part", "x", "ys", "cs", "x_text")
    right = text.withColumn("block", F.pmod("class", F.lit(blocks)).cast("int")).join(parts, "block").select("block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("class").alias("y"), F.col("text").alias("y_text"))

    def count(own: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if len(own) and len(others):
            wanted = set(pc.list_flatten(own.column("ys").combine_chunks()).to_pylist())
            others = others.filter(pc.is_in(others.column("y"), pa.array(list(wanted), pa.int64())))
            known = dict(zip(others.column("y").to_pylist(), shingle_sets(others.column("y_text"), n)))
            for x, ys, cs, s in zip(own.column("x").to_pylist(), own.column("ys").to_pylist(), own.column("cs").to_pylist(), shingle_sets(own.column("x_text"), n)):
                done: set[int] = set()
                for y, c in zip(ys, cs):
                    if c in done or (one and done):
                        continue
                    t = known[y]
                    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    overlap = int(np.count_nonzero(t[at] == s))
                    if 100 * overlap >= percent * (len(s) + len(t) - overlap):
                        done.add(c)
                        a.append(x)
                        b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(count, "a long, b long")


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
