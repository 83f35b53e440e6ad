"""Prefix trie of conversations by fixed-length block hashing.

A turn is a pair of 64-bit digests of role and text, salted by its depth; the
digest of a prefix is the exclusive or of its turns' digests, so that blocks of
BLOCK turns can be put together in any order and a running window gives each
block the digests before and behind it.  Conversations are grouped by these
block digests first: where all that reach a block leave it alike, the block is
one segment, whatever the number of its turns.  Only inside blocks where
siblings diverge (or end) turns become segments of their own.

Nodes of a segment have the same members.  Each node belongs to its smallest
member; a conversation owns the end of its path, from a depth behind the last
node that a smaller one holds.  With this one depth per conversation all that is
summed over subtrees is summed over members instead: for a node of depth d,
saved words are those that each member but the owner has from d to the last node
that it doesn't own; leaves and children are those that its members own.  So two
aggregates with partial sums on the map side give everything; there is no walk
along the tree, and no conversation is compared with another.

Keys that hold a two-thousandth of the rows or more (the root, common first
turns) come back to the rows by a broadcast of at most 2,000 rows, the others by
a shuffle in which none of them is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, durable, ship

#: Turns of a block.
BLOCK = 4
#: Members whose ids make one piece of the text that is hashed: ids of one run of so many numbers.
PIECE_BITS = 10
#: A key with at least 1 / OFTEN of all rows is often; there are at most OFTEN of them.
OFTEN = 2000

_KEY = ["last", "ka", "kb"]


def joined_back(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows left join found, which has one row a key and in ``n`` its number of rows: often ones by broadcast, so that none lands in one task."""
    often = F.col("n") * OFTEN >= total
    here, rest = [c for c in found.columns if c not in (*keys, "n")], rows.columns
    hot = F.broadcast(found.where(often).drop("n"))  # OFTEN rows at most, as their n add up to no more than total
    by_hot = rows.join(hot, keys).select(*rest, *here)
    by_key = rows.join(hot.select(*keys), keys, "left_anti").join(found.where(~often).drop("n"), keys, "left").select(*rest, *here)
    return by_hot.unionByName(by_key)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, depth, a, b, words: one row a turn, its place from 1, digests of role and text, and words of the text.

    Turns are ordered by ``turn_col``, null first, equal ones by their digests;
    so rows that repeat are turns that repeat.  Null role or text is empty; rows
    without a conversation are left out.
    """
    rows = columns(conversations, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text").where("conv IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    return rows.select("conv", F.row_number().over(order).alias("depth"), "a", "b", "words")


def forked(found: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin as another: c has the first h turns of c - c % every, then its own behind its first h; h = crc32(c) % most.

    ``found`` is of turns().  A conversation may lose all its turns; it is then
    among the ids alone.
    """
    found = durable(found)
    ids = found.select("conv").distinct()
    heads = found.where((F.col("conv") % every == 0) & (F.col("depth") < most)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    ids = ids.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base")).join(heads.withColumnRenamed("conv", "base"), "base", "left")
    ids = ids.select("conv", "h", F.filter("head", lambda x: x["depth"] <= F.col("h")).alias("head")).withColumn("begun", F.coalesce(F.size("head"), F.lit(0)).cast("int"))
    ids = durable(ids.withColumn("begun", F.greatest("begun", F.lit(0))))
    own = found.join(ids.select("conv", "h", "begun"), "conv").where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("begun")).alias("depth"), "a", "b", "words")
    head = ids.select("conv", F.explode("head").alias("x")).select("conv", "x.*")
    return head.unionByName(own), ids.select("conv")


def _segments(found: DataFrame, ids: DataFrame, block: int) -> DataFrame:
    """conv, length, first, last, ka, kb, before, words: parts of each conversation's path whose nodes have the same members, the root included."""
    salted = found.select("conv", "depth", F.xxhash64("depth", "a").alias("a"), F.xxhash64("depth", "b").alias("b"), "words").repartition("conv")
    of = F.floor((F.col("depth") - 1) / block).alias("k")
    blocks = salted.groupBy("conv", of).agg(F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("t"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("words").alias("w"))
    order = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(
        "conv", "k", "t", F.bit_xor("a").over(order).alias("ka"), F.bit_xor("b").over(order).alias("kb"), F.bit_xor("a").over(order).bitwiseXOR(F.col("a")).alias("ba"),
        F.bit_xor("b").over(order).bitwiseXOR(F.col("b")).alias("bb"), (F.sum("w").over(order) - F.col("w")).alias("before"), F.sum(F.size("t")).over(Window.partitionBy("conv")).alias("length"),
    )
    blocks = durable(blocks)
    group = ["k", "ba", "bb"]
    alike = lambda c: F.min(c) != F.max(c)
    split = blocks.groupBy(*group).agg(F.count("*").alias("n"), (alike("ka") | alike("kb")).alias("split")).where("split")
    blocks = joined_back(blocks, split, group, blocks.count())
    at = lambda c, i: F.aggregate(F.slice("t", F.lit(1), i), F.col("b" + c), lambda s, x: s.bitwiseXOR(x[c]))
    sums = lambda i: F.aggregate(F.slice("t", F.lit(1), i), F.col("before"), lambda s, x: s + x["words"])
    whole = F.array(F.struct(F.col("t")[0]["depth"].alias("first"), F.element_at("t", -1)["depth"].alias("last"), F.col("ka").alias("ka"), F.col("kb").alias("kb"), F.col("before").alias("before"), F.col("t.words").alias("words")))
    single = F.transform("t", lambda x, i: F.struct(x["depth"].alias("first"), x["depth"].alias("last"), at("a", i + 1).alias("ka"), at("b", i + 1).alias("kb"), sums(i).alias("before"), F.array(x["words"]).alias("words")))
    parts = blocks.select("conv", "length", F.explode(F.when(F.col("split"), single).otherwise(whole)).alias("s")).select("conv", "length", "s.*")
    lengths = blocks.select("conv", "length").distinct()
    zero = F.lit(0).cast("long")
    root = ids.join(lengths, "conv", "left").select("conv", F.coalesce("length", zero).alias("length"), F.lit(0).alias("first"), F.lit(0).alias("last"), zero.alias("ka"), zero.alias("kb"), zero.alias("before"), F.array(zero).alias("words"))
    return durable(root.unionByName(parts))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which come sorted; one state of the hash is held."""
    key, state = None, None
    for b in batches:
        out = []
        for *k, piece in zip(*(b.column(c).to_pylist() for c in (*_KEY, "piece"))):
            if k != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield _rows(out)
    if key is not None:
        yield _rows([(*key, state.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))], [*_KEY, "ends_sha256"])


def _ends(parts: DataFrame) -> DataFrame:
    """last, ka, kb, ends_sha256 of nodes at which conversations end: ids of 1,024 numbers make a piece, and a node's pieces stream through one hash."""
    ends = parts.where("last = length").groupBy(*_KEY, F.shiftright("conv", PIECE_BITS).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("piece"))
    return ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").select(*_KEY, "piece").mapInArrow(_hashed, "last int, ka long, kb long, ends_sha256 string")


def trie(found: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``found`` is of turns(); ``ids`` (conv) names conversations that may be
    without turns, too.  No conversations, no nodes; else there is a root.  A
    conversation's turns are 24 bytes each here and come in order through one
    task; of texts only digests move.
    """
    ship(found.sparkSession)
    parts = _segments(found, found.select("conv").distinct() if ids is None else ids, block)
    total = parts.count()
    nodes = parts.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("conv").alias("owner"), F.max("length").alias("deepest")).where("n > 1")
    all_words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    light = parts.select("conv", "length", *_KEY, (F.col("before") + all_words("words")).alias("through"))
    known = joined_back(light, nodes, _KEY, total).withColumn("owner", F.coalesce("owner", "conv")).withColumn("deepest", F.coalesce("deepest", "length"))
    other = F.max(F.when(F.col("owner") != F.col("conv"), F.struct("last", "through", "owner"))).alias("s")
    leaf = F.max(((F.col("owner") == F.col("conv")) & (F.col("last") == F.col("length")) & (F.col("deepest") == F.col("length"))).cast("long")).alias("leaf")
    convs = known.groupBy("conv").agg(other, leaf).select("conv", "leaf", F.coalesce("s.last", F.lit(-1)).alias("till"), F.coalesce("s.through", F.lit(0)).alias("through"), "s.owner")
    out = parts.join(convs, "conv").groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"),
        F.min(F.struct("conv", "first", "before", "words", "till", "owner")).alias("o"),
        F.sum(F.when(F.col("till") >= F.col("first"), F.col("through")).otherwise(0)).alias("shared"),
        F.sum(((F.col("till") <= F.col("last")) & (F.col("last") < F.col("length"))).cast("long")).alias("children"),
        F.sum("leaf").alias("n_leaves"),
    )
    out = out.join(_ends(parts), _KEY, "left")
    one = F.lit(1).cast("long")

    def node(_: Column, i: Column) -> Column:
        final = F.col("o.first") + i == F.col("last")
        before = F.aggregate(F.slice("o.words", F.lit(1), i), F.col("o.before"), lambda s, x: s + x)
        parent = F.when((i > 0) | (F.col("o.till") < F.col("o.first") - 1), F.col("o.conv")).otherwise(F.col("o.owner"))
        return F.struct(
            (F.col("o.first") + i).cast("long").alias("depth"), F.when(F.col("o.first") + i > 0, parent).alias("parent_conv_id"), F.when(final, F.col("children")).otherwise(one).alias("n_children"),
            (F.col("shared") - (F.col("n_convs") - 1) * before).alias("saved_tokens"), F.when(final, F.col("ends_sha256")).alias("ends"),
        )

    out = out.select(F.col("o.conv").alias("conv_id"), "n_convs", "n_leaves", F.explode(F.transform("o.words", node)).alias("d"))
    return out.select("conv_id", "d.depth", "d.parent_conv_id", "n_convs", "d.n_children", "n_leaves", "d.saved_tokens", F.coalesce("d.ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*forked(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: crc32 of the UTF-8 text {0}, of code points below 128, bit by bit.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length({0})), lambda i: ((ascii(substr({0}, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::BIGINT)), lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"

OP13_SQL = f"""
WITH turned AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS base, {CRC_SQL.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM turned)),
joined AS (SELECT ids.c, 0 AS own, p, x, w FROM ids JOIN turned ON turned.c = ids.base AND p <= h UNION ALL SELECT ids.c, 1, p, x, w FROM ids JOIN turned ON turned.c = ids.c AND p > h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, x, w FROM joined),
path AS (SELECT c, d, string_agg(x, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS k, w FROM placed UNION ALL SELECT c, 0, '', 0 FROM ids),
ended AS (SELECT c, max(d) AS len FROM path GROUP BY c),
node AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len), '') AS ends FROM path JOIN ended USING (c) GROUP BY d, k),
tied AS (SELECT u.d, u.k, v.k AS parent_k, v.c AS parent_c FROM node u JOIN path q ON q.c = u.c AND q.d = u.d - 1 JOIN node v ON v.d = q.d AND v.k = q.k),
kids AS (SELECT d - 1 AS d, parent_k AS k, count(*) AS n FROM tied GROUP BY ALL),
below AS (SELECT q.d, q.k, sum((u.n - 1) * u.w) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM node u JOIN path q ON q.c = u.c AND q.d <= u.d LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k GROUP BY q.d, q.k)
SELECT node.c AS conv_id, node.d AS depth, tied.parent_c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM node JOIN below USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN tied USING (d, k)
"""
