"""From documents to token ids: five stages, each a DataFrame of what the one before it kept.

STAGES lists (name, function of (spark, docs, sf_dir)); every stage but the last
returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import bpe, language_id, line_dedup, mixing, ngram_join
from auditlake.llm.common import free, shared_folder

#: Least score of a predicted language that a document needs to stay.
LEAST_SCORE = 0.15
#: Words from which on a repeated line, or pair, goes without two neighbours that are repeated too.
LINE_WORDS = 8
_LAST = (1 << 63) - 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter or far from every profile go.

    A row goes along as one value, so that its columns may have any names.
    """
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = language_id.language_id(rows, language_id.fit(docs), keep=("row",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents of which nothing is left go.

    Columns of documents that have a name that the operator makes go by another meanwhile.
    """
    other = {c: free(f"{c}__", docs) for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(other), words=LINE_WORDS)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).drop("n_lines", "n_removed").withColumnsRenamed({b: a for a, b in other.items()})
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest id (null is the largest), of rows with that id that of smallest text hash.

    Rows that repeat an id and a text are one document.  Documents without words
    are no duplicates of each other and stay.
    """
    found = ngram_join.ngram_join(docs, groups=True)
    own = F.coalesce("doc_id", F.lit(_LAST))
    first = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(own.alias("k"), "check")).alias("m")).select("m.k", "m.check")
    kept = first.unionByName(found.where("n_shingles = 0").select(own.alias("k"), "check").distinct())
    k, check = free("k__", docs), free("check__", docs)
    keyed = docs.withColumn(k, own).withColumn(check, F.xxhash64("text"))
    return keyed.join(kept.withColumnsRenamed({"k": k, "check": check}), [k, check], "left_semi").dropDuplicates([k, check]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, on average; rows with a null id, too."""
    labels = mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = F.coalesce("doc_id", F.lit(_LAST))
    k, check, copies = free("k__", docs), free("check__", docs), free("copies__", docs)
    found = mixing.mix(docs, labels, mixing.WEIGHTS).where("copies > 0").select(own.alias(k), F.col("text_key").alias(check), F.col("copies").alias(copies)).distinct()
    out = docs.withColumn(k, own).withColumn(check, F.xxhash64("text")).join(found, [k, check])
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("lang", "source"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Two stages (language, mixture) rest on learned models, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
