"""Catalogues of scores from manifests, file names and nested JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_FILES = r"\.(xml|musicxml|mxl)$"


def discover_scores(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of score files below ``root``, whatever the case of their extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.lower("path").rlike(SCORE_FILES)).select("path", "length")


def filename_fields(df: DataFrame, name: str, fields: list[str], defaults: dict[str, str]) -> DataFrame:
    """Adds the fields that double hyphens part in a name; missing or empty ones get their default or null."""
    parts = F.split(name, "--")
    values = {f: F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i, f in enumerate(fields)}
    return df.withColumns({f: F.coalesce(v, F.lit(defaults[f])) if f in defaults else v for f, v in values.items()})


def resolve_paths(rows: DataFrame, key: str, candidates: list[Column], existing: DataFrame) -> DataFrame:
    """``(key, resolved)``: of each row's candidates in order, the first in ``existing(path)``; rows without are left out."""
    options = F.posexplode(F.array(*candidates)).alias("place", "path")
    found = rows.select(key, options).where("path is not null").join(existing.distinct(), "path", "left_semi")
    return found.groupBy(key).agg(F.min_by("path", "place").alias("resolved"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def nested_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``(path, payload, status)`` of JSON files whose ``encodings`` is an object or an array of objects.

    The payload's key is ``musicxml`` or ``MusicXML``; a file without has status ``missing_musicxml_encoding``.
    """
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    v = F.try_parse_json("value")
    spots = [f"$.encodings{i}.{k}" for i in ("", "[0]") for k in ("musicxml", "MusicXML")]
    payload = F.coalesce(*[F.try_variant_get(v, s, "string") for s in spots])
    status = F.when(payload.isNull(), "missing_musicxml_encoding").otherwise("written")
    return texts.select("path", payload.alias("payload"), status.alias("status"))


def union_catalogs(catalogs: list[DataFrame]) -> DataFrame:
    """Catalogues of several sources in one, columns that one lacks being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)


def collect_runs(spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
    """A row for each run below ``root`` (``kind=K/run=R`` folders of one JSON object): fields of every kind there is.

    ``kinds`` gives the schema of each kind. ``status`` is complete if no kind is missing and
    readable, else partial; an object that can't be read counts as missing.
    """
    text = spark.read.text(root)
    out = text.select("run").distinct()
    for kind, schema in kinds.items():
        fields = F.from_json("value", schema, {"mode": "PERMISSIVE"})
        rows = text.where(F.col("kind") == kind).select("run", fields.alias("o")).where("o is not null")
        out = out.join(rows.select("run", "o.*", F.lit(True).alias(f"has_{kind}")), "run", "left")
    whole = reduce(lambda a, b: a & b, [F.col(f"has_{k}").isNotNull() for k in kinds])
    return out.withColumn("status", F.when(whole, "complete").otherwise("partial")).drop(*[f"has_{k}" for k in kinds])
