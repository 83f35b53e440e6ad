"""Configuration documents of any shape as VARIANT values: manifests, lists of them, several in one text; Compose files as mounts.

Documents come as JSON text (YAML is turned into it upstream).  Values keep their
own types, so that "true" is no true and 5 is no text; what cannot be read gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(v: Column, path: str) -> Column:
    """The value at a path as JSON text, which tells its type; null if there is none."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """A value at a path if it is a text, else null."""
    return F.when(at(v, path).startswith('"'), F.try_variant_get(v, path, "string"))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce(at(v, path) == "true", F.lit(False))


def objects(texts: DataFrame, doc: str = "doc") -> DataFrame:
    """texts with v, a row an object: documents of a text are parted by lines ``---``; an array is its elements, and a List its items."""
    rest = [c for c in texts.columns if c != doc]
    parts = texts.select(*rest, F.explode(F.split(doc, r"(?m)^---[ \t]*\r?$")).alias("part__")).select(*rest, F.try_parse_json("part__").alias("v"))
    parts = parts.select(*rest, F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))
    items = F.when(F.try_variant_get("v", "$.kind", "string") == "List", F.coalesce(F.try_variant_get("v", "$.items", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array("v"))
    return parts.select(*rest, F.explode(items).alias("v")).where(F.col("v").isNotNull())


def manifests(texts: DataFrame) -> DataFrame:
    """Objects that say their kind and apiVersion, with kind and name (? if there is none)."""
    kind, name = F.try_variant_get("v", "$.kind", "string"), F.try_variant_get("v", "$.metadata.name", "string")
    return objects(texts).withColumn("kind", kind).where(F.col("kind").isNotNull() & at(F.col("v"), "$.apiVersion").isNotNull()).withColumn("name", F.coalesce(name, F.lit("?")))


def mounts(composes: DataFrame) -> DataFrame:
    """composes (doc, a Compose file) with service, source (null: anonymous), target, raw: a row a volume of a service, short or long form."""
    rest = [c for c in composes.columns if c != "doc"]
    services = objects(composes).select(*rest, F.explode(F.try_variant_get("v", "$.services", "map<string,variant>")).alias("service", "s"))
    volumes = services.select(*rest, "service", F.explode(F.try_variant_get("s", "$.volumes", "array<variant>")).alias("e"))
    short = text_at(F.col("e"), "$")
    parts = F.split(short, ":", -1)
    source = F.when(short.isNull(), text_at(F.col("e"), "$.source")).when(F.size(parts) > 1, F.get(parts, F.lit(0)))
    target = F.when(short.isNull(), text_at(F.col("e"), "$.target")).when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(short)
    return volumes.select(*rest, "service", source.alias("source"), target.alias("target"), F.coalesce(short, F.to_json("e")).alias("raw")).where("target IS NOT NULL")
