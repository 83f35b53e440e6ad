"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three
characters, a word padded by one blank at either side), most frequent first.  A
document's own list is compared with each profile by the out-of-place distance:
the sum over its n-grams of how far each stands from its place in the profile,
absent ones costing the most.  Profiles are learned with Spark from a bounded
sample of labelled texts; every document is then scored whole, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, ship

#: n-grams of a profile, and of a document's own list.
PROFILE = 400
#: Labelled texts of one language that learning takes, at most; those with the smallest hash of the id.
SAMPLE = 1500
_U = np.uint64
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for what is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of a text's words, packed by 21 bits a character, with their counts."""
    points = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[32], points, [32]]).astype(_U)
    letter = points != 32
    points = points[letter | np.r_[True, letter[:-1]]]  # a run of blanks becomes one
    letter = points != 32
    two = (points[:-1] << _U(21)) | points[1:]
    three = (two[:-1] << _U(21)) | points[2:]
    # a blank may stand at an n-gram's ends only
    keys = np.concatenate([points[letter], two, three[letter[1:-1]]])
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller key."""
    if len(keys) > 4 * size:  # all that the size-th count reaches
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, profile: int = PROFILE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles by language.  ``sample`` texts a language at most are counted, chosen by a hash of id and text; counts are summed by Spark.

    Rows that repeat both are one text, so that they don't widen the sample.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = columns(labelled, id_col, text_col, lang_col).toDF("id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    # two steps, so that a language that has most rows is not ranked in one task
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"), "text"))
    light = rows.select("lang", "h").groupBy("lang").agg(F.count("*").alias("n"))
    size = light.withColumn("most", F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n")))
    near = rows.join(F.broadcast(size.select("lang", "most")), "lang").where((F.col("most") >= 1) | (F.col("h").cast("double") < F.lit(-(2.0**63)) + F.col("most") * 2.0**64))
    from pyspark.sql import Window

    pick = near.select("lang", "id", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= sample).select("lang", "id", "h")
    chosen = near.join(F.broadcast(pick.select("lang", "h").distinct()), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frame = b.to_pandas()
            for lang, own in frame.groupby("lang"):
                got = [grams(x) for x in own["text"]]
                keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in got]).astype(float))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n.astype(np.int64)}), preserve_index=False)

    counted = chosen.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= profile)
    found: dict[str, list[tuple[int, int]]] = {}
    for x in top.select("lang", "r", "key").collect():  # languages times PROFILE rows
        found.setdefault(x["lang"], []).append((x["r"], x["key"]))
    return {k: np.array([key for _, key in sorted(v)], np.int64).view(_U) for k, v in sorted(found.items())}


class Model:
    """Profiles as one sorted table of n-grams with their places in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.zeros(0, _U)
        self.place = np.full((len(self.names), len(self.keys) + 1), -1, np.int32)
        for i, n in enumerate(self.names):
            self.place[i, np.searchsorted(self.keys, profiles[n])] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties to the first by name) and 1 minus its distance over the largest possible one."""
        if not text or not self.names:
            return "und", 0.0
        own = ranked(*grams(text), self.size)
        own = own[own != _U(32)]
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        place = self.place[:, at]
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))))
        total = away.sum(1)
        best = int(np.argmin(total))
        return self.names[best], float(1 - total[best] / (self.size * len(own)))


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, lang_pred, score for every row, from the whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned.  Repeated and null ids are rows like any other, an empty table gives
    an empty result, and a text of any length is counted as a whole in one task.
    ValueError if ``keep`` names a column lang_pred or score.
    """
    if clash := {k.lower() for k in (id_col, *keep)} & {"lang_pred", "score"}:
        raise ValueError(f"a column to keep is called {sorted(clash)[0]}, as one that is made")
    spark = docs.sparkSession
    ship(spark)
    told = spark.sparkContext.broadcast((model.names, model.keys, model.place, model.size))  # languages x profile numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.names, own.keys, own.place, own.size = told.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            got = [own.predict(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    if text_col in (id_col, *keep):
        raise ValueError("the text goes to the prediction only")
    rows = columns(docs, id_col, *keep, text_col)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{shape}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learned from the rows of documents that are not held out."""
    return Model(learn(docs.where(~held_out()), "doc_id", "text", "lang"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
