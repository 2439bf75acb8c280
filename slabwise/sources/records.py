"""Record files and edge formats."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "struct<text:string,temperature:double,top_p:double,index:int,is_reference:boolean,score:double>"
#: Declared schemas of the record files; labels stay JSON text, whatever their shape.
SCHEMAS = {
    "cases": "case_id string, images array<string>, prompt string, response string, labels string",
    "candidates": f"case_id string, images array<string>, prompt string, labels string, candidates array<{CANDIDATE}>",
    "pairwise": "case_id string, images array<string>, prompt string, labels string, chosen string, rejected string, chosen_score double, rejected_score double",
    "binary": "case_id string, images array<string>, prompt string, labels string, response string, preference string, score double",
    "group": "case_id string, images array<string>, prompt string, labels string, candidates array<struct<response:string,score:double>>, reference string",
    "predictions": "case_id string, prediction string",
}


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores where its files are too few for that; a large table stays as it is,
    without a shuffle. For row-wise work that costs far more than moving the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSONL file by its declared schema; blank lines are skipped, a malformed line raises.
    Missing labels become '{}'. Only the columns that are used are parsed."""
    df = spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST").json(path)
    return df.withColumn("labels", F.coalesce("labels", F.lit("{}"))) if "labels" in df.columns else df


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written."""
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def default_case_id(df: DataFrame, position: str) -> DataFrame:
    """case_id, or pref_<position> where a preference row has none."""
    return df.withColumn("case_id", F.coalesce("case_id", F.concat(F.lit("pref_"), F.col(position).cast("string"))))


def images_with_files(df: DataFrame, key: str, images: str, files: DataFrame, most: int = 4) -> DataFrame:
    """(key, pos, path, exists) of each row's first images against files (path, ...); the prefix is
    taken before the join, so no other path is looked up."""
    e = df.select(key, F.posexplode(F.slice(F.coalesce(F.col(images), F.array().cast("array<string>")), 1, most)).alias("pos", "path"))
    f = files.select(F.col("path").alias("_f")).distinct()
    return e.join(f, F.col("path") == F.col("_f"), "left").select(key, "pos", "path", F.col("_f").isNotNull().alias("exists"))


def black_png(width: int = 448, height: int = 448) -> bytes:
    """A black RGB image as PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes((1 + 3 * width) * height))) + chunk(b"IEND", b"")


def load_images(df: DataFrame, key: str, images: str, files: DataFrame, most: int = 4) -> DataFrame:
    """(key, pos, path, content, placeholder) of each row's first images; where files (path, content) has
    none, the content is a black image. Null paths have no row."""
    e = df.select(key, F.posexplode(F.slice(F.coalesce(F.col(images), F.array().cast("array<string>")), 1, most)).alias("pos", "path")).filter("path IS NOT NULL")
    f = files.select(F.col("path").alias("_f"), "content")
    j = e.join(f, F.col("path") == F.col("_f"), "left")
    return j.select(key, "pos", "path", F.coalesce("content", F.lit(black_png())).alias("content"), F.col("_f").isNull().alias("placeholder"))


def stamped(root: str, name: str, at: datetime) -> str:
    """The output folder of a run: <root>/<name>_YYYYmmdd_HHMMSS."""
    return f"{root.rstrip('/')}/{name}_{at:%Y%m%d_%H%M%S}"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every <patient>/manifest.json under a root, with its patient."""
    df = spark.read.option("multiLine", "true").schema("protocol struct<image_budget:int>, orientation struct<original:string>, images array<struct<file:string,view:string,slab_index:int,coverage_band:string,side:string>>").json(f"{root}/*/manifest.json")
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest\.json$", 1).alias("patient"), F.col("protocol.image_budget").alias("image_budget"), F.col("orientation.original").alias("orientation_original"), "images")
