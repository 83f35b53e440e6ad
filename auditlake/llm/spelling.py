"""Spelling variant grouping by pivotal grams.

Two words are near if they differ by one inserted, deleted or replaced code
point.  Bigrams are ordered by the number of places that words hold them, rare
ones first.  A word's prefix is its three rarest bigrams and all others that are
as rare; its pivots are two disjoint bigrams of the prefix that together are the
rarest, found by dynamic programming over their places.  One edit leaves one of
two disjoint bigrams alone.  If the rarest-three bound of the other word is no
lower, that pivot lies in the other's prefix, so a join of pivots with prefixes
finds each near pair from one of its sides.

Position limits make the join narrow: the edit lies wholly to the right or
wholly to the left of the untouched pivot.  What lies on the other side is the
same in both words, and so is one half of the side it lies on.  The join's key is
the hash of those same code points, of the pivot's place from that side and of
the other word's length there.  A pair that meets is verified by edit distance.

Of a bigram that a word holds often, pivots are among its first four places (a
place excludes itself and two neighbours), and an edit moves a place by at most
two, so that a prefix needs its first six.  Words of more than LONG code points
meet under a digest and are fetched only for the pairs that meet.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, durable, ship, stored

#: Fewest code points of a word, fewest occurrences, and by how much a form must outweigh a word.
LEAST_LENGTH, LEAST_COUNT, OUTWEIGHS = 7, 2, 10
#: Every so many-th pair of document and run (by crc32) loses a code point.
DELETES = 31
#: Longest word that goes along in the join itself.
LONG = 64
#: Rarest bigrams of a prefix for one edit of bigrams, and first places of one bigram that are pivots and are indexed.
PREFIX, PIVOT_PLACES, INDEX_PLACES = 3, 4, 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deletes: int = DELETES, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters, lower-cased (A-Z), one code point deleted where ``deletes`` divides the crc32 of id, colon and run.

    Only runs of ``least_length`` and more can give words, as a deletion never
    makes one longer.  A null text has no runs; a null id is an empty text.
    """
    rows = columns(docs, id_col, text_col).toDF("id", "text").where("text IS NOT NULL")
    runs = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % deletes == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank (rarest first) and number of places of each bigram: its size is the square of the alphabet's (8,100 for the query's), whatever the number of words."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: (k, r["n"]) for k, r in enumerate(sorted(grams.collect(), key=lambda r: (r["n"], r["gram"])))}


def pivots(places: list[tuple[int, int]]) -> list[int]:
    """Two disjoint places of least total weight out of (place, weight) in ascending order of place: for each the lightest two behind it."""
    best: tuple[int, int, int] | None = None
    lightest: tuple[int, int] | None = None  # of the places that end before this one
    done = 0
    for at, weight in places:
        while places[done][0] <= at - 2:
            if lightest is None or places[done][1] < lightest[0]:
                lightest = (places[done][1], places[done][0])
            done += 1
        if lightest is not None and (best is None or lightest[0] + weight < best[0]):
            best = (lightest[0] + weight, lightest[1], at)
    return list(best[1:])


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """Rank of the prefix's last bigram, places to index, pivots."""
    places: dict[str, list[int]] = defaultdict(list)
    for i in range(len(word) - 1):
        places[word[i : i + 2]].append(i)
    left, last, index, chosen = PREFIX, 0, [], []
    for gram in sorted(places, key=lambda g: order[g][0]):
        last, weight = order[gram]
        index += places[gram][:INDEX_PLACES]
        chosen += [(i, weight) for i in places[gram][:PIVOT_PLACES]]
        left -= len(places[gram])
        if left <= 0:
            break
    return last, index, pivots(sorted(chosen))


def _signed(order: dict[str, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                last, index, chosen = zip(*(signature(w, order) for w in b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(last, pa.int32()), pa.array(index, pa.list_(pa.int32())), pa.array(chosen, pa.list_(pa.int32()))], ["word", "last", "index", "pivots"])

    return run


def _keys(at: Column, change: int) -> Column:
    """Keys of the bigram at a place, for words that are longer by ``change`` on the side where the edit lies: at most four."""
    word, length = F.col("word"), F.length("word")
    before, after = at, length - at - 2  # code points on either side
    tail = lambda n: F.substring(word, length - n + 1, n)
    out = []
    for right in (True, False):
        side, other = (after, before) if right else (before, after)
        there = side + change
        half = F.floor(there / 2).cast("int")
        rest = there - half
        same = F.substring(word, F.lit(1), before + 2) if right else tail(after + 2)
        near = F.substring(word, F.lit(1), before + 2 + half) if right else tail(after + 2 + half)
        far = tail(rest) if right else F.substring(word, F.lit(1), rest)
        fits = (there >= 0) & (F.greatest(side, there) > 0)
        out.append(F.when(fits, F.xxhash64(F.lit(2 * right), other, there, near)))
        out.append(F.when(fits & (rest <= side), F.xxhash64(F.lit(2 * right + 1), other, there, same, far)))
    return F.array_compact(F.array(*out))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: each near pair of the column ``word`` of distinct words of four code points or more, both ways round."""
    spark = words.sparkSession
    ship(spark)
    words = words.select("word")
    order = spark.sparkContext.broadcast(gram_order(words)).value
    signed = words.mapInArrow(_signed(order), "word string, last int, index array<int>, pivots array<int>")
    ref = F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2(F.col("word").cast("binary"), 256)))
    signed = stored(signed.withColumn("ref", ref))
    index = signed.select(F.col("ref").alias("a"), F.col("last").alias("a_last"), F.explode(F.array_distinct(F.flatten(F.transform("index", lambda p: _keys(p, 0))))).alias("key"))
    tried = F.flatten(F.transform("pivots", lambda p: F.concat(*(_keys(p, c) for c in (-1, 0, 1)))))
    pivot = signed.select(F.col("ref").alias("b"), F.col("last").alias("b_last"), F.explode(F.array_distinct(tried)).alias("key"))
    short = ~F.col("a").startswith("#") & ~F.col("b").startswith("#")
    near = F.levenshtein("a", "b", 1) == 1
    met = index.join(pivot, "key").where((F.col("a_last") >= F.col("b_last")) & (F.col("a") != F.col("b")) & (~short | near)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = stored(met)
    whole = signed.where(F.length("word") > LONG - 1).select("ref", "word")
    far = met.where(~short).join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").where(F.levenshtein("x", "y", 1) == 1).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = met.where(short).unionByName(far)
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def variants(words: DataFrame, outweighs: int = OUTWEIGHS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct (word, n) of four code points or more.

    The form is the near word of largest n, of equal ones the smallest in
    code-point order, if its n is ``outweighs`` times the word's or more; the
    root is the end of a chain of forms.  Words without form are their own root.
    No words give no rows.
    """
    words = durable(words.select("word", "n"))
    pairs = near_pairs(words)
    other = words.withColumnsRenamed({"word": "b", "n": "m"})
    near = pairs.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= F.col("n") * outweighs, F.struct(F.col("best.b").alias("form"), (-F.col("best.m")).alias("form_n"))).alias("f"))
    out = durable(out.select("word", "f.form", "n", "n_near", "f.form_n"))
    links = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, outweighs)) if outweighs > 1 else 64  # n grows by outweighs a step
    for _ in range(max(0, steps - 1).bit_length()):  # each round doubles how far a link reaches
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        links = durable(links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")))
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: crc32 of the UTF-8 bytes of {0}, bit by bit.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 4 * length(hex({0}))), lambda i: (((strpos('0123456789ABCDEF', substr(hex({0}), (i // 8 * 2 + 1 + CASE WHEN i % 8 < 4 THEN 1 ELSE 0 END)::INT, 1)) - 1) >> (i % 4)::INT) & 1)::BIGINT)), lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)"

OP11_SQL = f"""
WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS r FROM documents WHERE text IS NOT NULL),
hashed AS MATERIALIZED (SELECT r, k, {_CRC_SQL.format("k")} AS h FROM (SELECT r, coalesce(doc_id::VARCHAR, '') || ':' || r AS k FROM run WHERE length(r) >= {LEAST_LENGTH})),
result AS (SELECT CASE WHEN h % {DELETES} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM result WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT less.word, w.word FROM less JOIN w ON w.word = less.rest UNION SELECT w.word, less.word FROM less JOIN w ON w.word = less.rest),
best AS (SELECT near.a AS word, count(*) AS n_near, arg_min(near.b, (-w.n, near.b)) AS b, max(w.n) AS m FROM near JOIN w ON w.word = near.b GROUP BY near.a),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {OUTWEIGHS} * w.n THEN b END AS form, CASE WHEN m >= {OUTWEIGHS} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
climb AS (SELECT word, word AS top FROM formed UNION ALL SELECT climb.word, formed.form FROM climb JOIN formed ON formed.word = climb.top WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, climb.top AS root, f.n, f.n_near, f.form_n FROM formed f JOIN climb ON climb.word = f.word JOIN formed t ON t.word = climb.top WHERE t.form IS NULL
"""
