"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Every window of ``run`` consecutive lines selects the position of its least line
hash: two places that share ``run`` lines are then guaranteed to share a
fingerprint.  If ``words`` is given, a window ends as soon as it holds so many
words, so that a long line, or a pair, is a fingerprint by itself; short lines
still need ``run``.  Only selected positions are kept, about half of the lines.
Those whose line occurs at one of them alone in the corpus (the most, by far) end
there; the others are joined, and the match is extended to the lines before and
behind the fingerprint that its windows hold: each window finds the first place
that has the same lines.  Windows that follow each other extend a run both ways
to its full length, and runs that have an earlier place are deleted.

Counts and first places are partial aggregates and come back by joins with one
row a key and salt, so that a line that a third of all documents hold is split
like any other; a document is never compared with each of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, durable, free

#: White space of a line that counts as blank.
_WORD = "[^\\x20\\x09-\\x0D]"
_LAST = (1 << 63) - 1
#: Parts that the places of one fingerprint are dealt out to.
SALT = 8


def _salted(df: DataFrame) -> DataFrame:
    """df once for each salt, so that the rows of a key of the other side are dealt out to SALT tasks."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, words: int | None = None) -> DataFrame:
    """doc, check, first, last: runs of lines (counted from 0) that an earlier place holds too, blank ones left out.

    ``doc`` is the id (the largest long for null) and ``check`` a hash of the
    text, which together name a document.  Places are ordered by id, then line.
    """
    rows = columns(docs, id_col, text_col).toDF("doc", "text").where("text IS NOT NULL")
    rows = rows.select(F.coalesce(F.col("doc").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("check"), F.split("text", "\n", -1).alias("l"))
    numbered = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), x.alias("l"))), lambda x: x["l"].rlike(_WORD))
    lines = rows.select("doc", "check", numbered.alias("l")).where(F.size("l") >= (run if words is None else 1))
    pair = lambda x: F.struct(F.xxhash64(x["l"]).alias("a"), F.xxhash64(F.lit(1), x["l"]).alias("b"))
    count = F.transform("l", lambda x: F.lit(0) if words is None else F.regexp_count(x["l"], F.lit(_WORD + "+")))
    lines = lines.select("doc", "check", F.transform("l", pair).alias("h"), F.col("l.i").alias("i"), count.alias("c"))

    def length(k: Column) -> Column:
        """Lines of the window at k, null if the document ends before it does."""
        if words is None:
            return F.lit(run)
        held, out = F.get("c", k), F.when(F.get("c", k) >= words, 1)
        for j in range(1, run):
            held = held + F.get("c", k + j)
            out = out.when(held >= (words if j < run - 1 else 0), j + 1)
        return out

    cut = lambda k, n: F.slice("h", k + 1, F.coalesce(n, F.lit(1)))
    window = F.transform(
        F.sequence(F.lit(0), F.size("h") - (run if words is None else 1)),
        lambda k: F.struct(
            k.alias("at"),
            (k + length(k) - 1).alias("end"),
            # the position of the least hash, the first of equal ones
            (k + F.array_position(cut(k, length(k)), F.array_min(cut(k, length(k)))).cast("int") - 1).alias("least"),
            F.xxhash64(cut(k, length(k))).alias("wa"),
            F.xxhash64(F.lit(1), cut(k, length(k))).alias("wb"),
        ),
    )
    lines = lines.withColumn("w", window)
    # windows that selected a position begin at most run - 1 lines before it
    own = lambda p: F.filter(F.slice("w", F.greatest(F.lit(1), p - run + 2), F.least(p + 1, F.lit(run))), lambda w: (w["least"] == p) & w["end"].isNotNull())
    chosen = F.array_distinct(F.transform(F.filter("w", lambda w: w["end"].isNotNull()), lambda w: w["least"]))
    place = lambda w: F.struct(w["at"].alias("at"), w["end"].alias("end"), F.get("i", w["at"]).alias("first"), F.get("i", w["end"]).alias("last"), w["wa"].alias("wa"), w["wb"].alias("wb"))
    prints = lines.select("doc", "check", F.explode(F.transform(chosen, lambda p: F.struct(F.get("h", p)["a"].alias("mark"), p.alias("least"), F.transform(own(p), place).alias("windows")))).alias("f"))
    prints = durable(prints.select("doc", "check", "f.mark", "f.windows", F.pmod(F.xxhash64("doc", "f.least"), F.lit(SALT)).cast("int").alias("salt")))
    marks = prints.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    known = prints.join(_salted(marks), ["mark", "salt"], "left_semi").select("doc", "check", "mark", "salt", F.explode("windows").alias("w")).select("doc", "check", "mark", "salt", "w.*")
    place = F.struct("doc", "at", "check")
    held = known.groupBy("mark", "wa", "wb").agg(F.min(place).alias("held"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = known.join(_salted(held), ["mark", "wa", "wb", "salt"]).where((F.col("held.doc") != F.col("doc")) | (F.col("held.at") != F.col("at"))).select("doc", "check", "at", "end", "first", "last").distinct()
    w = Window.partitionBy("doc", "check").orderBy("at")
    begun = later.withColumn("new", (F.col("at") - F.lag("end").over(w) > 1).cast("int"))
    part = begun.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return part.groupBy("doc", "check", "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("part")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, words: int | None = None) -> DataFrame:
    """docs with the later repeated runs of ``run`` or more lines deleted from the text, and n_lines, n_removed after the other columns.

    A line is deleted if it belongs to ``run`` consecutive lines (blank lines
    left out), or to fewer that hold ``words`` words, that also stand at an
    earlier place: in a document of smaller id, or further up in the same one.  Blank lines stay, as do documents all of
    whose lines go, with what is left (an empty text if nothing is).  A null
    text stays null and has no lines; documents with a null id come last; rows
    that repeat an id and a text are one document, whose text repeats nothing
    by that.  Column names n_lines and n_removed must be free.
    """
    if {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError("docs has a column n_lines or n_removed")
    runs = repeated_runs(docs, id_col, text_col, run, words)
    doc, check, gone_ = (free(x, docs) for x in ("doc__", "check__", "gone__"))
    gone = runs.groupBy("doc", "check").agg(F.collect_list(F.struct("first", "last")).alias(gone_)).select(F.col("doc").alias(doc), F.col("check").alias(check), gone_)
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn(doc, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))).withColumn(check, F.xxhash64(text))
    lines = F.split(text, "\n", -1)
    out = keyed.join(gone, [doc, check], "left").drop(doc, check)
    hit = F.col(gone_).isNotNull()
    stays = lambda x, i: ~x.rlike(_WORD) | ~F.exists(gone_, lambda g: i.between(g["first"], g["last"]))
    kept = F.filter(lines, stays)
    new = {
        text_col: F.when(hit, F.array_join(kept, "\n")).otherwise(text),
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(hit, F.size(lines) - F.size(kept)).otherwise(0).cast("long"),
    }
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns), new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The kept text of every row of documents, as a subquery's columns doc_id, text, n_lines, n_removed.
KEPT_SQL = r"""
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
triple AS (SELECT doc_id, k, l AS a, lead(l, 1) OVER o AS b, lead(l, 2) OVER o AS c FROM filled WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
again AS (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS place FROM triple WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM again, (SELECT unnest([0, 1, 2]) AS j) WHERE place > 1),
kept AS (SELECT line.doc_id, line.i, line.l, gone.k IS NOT NULL AS dropped FROM line LEFT JOIN filled USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = filled.doc_id AND gone.k = filled.k),
cleaned AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed FROM kept GROUP BY doc_id)
"""
OP4_SQL = f"""
WITH {KEPT_SQL}
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.text, '')) AS kept_sha256
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""
